from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators import alignment, interchange

NODES = [("p", "s", "START_EVENT", "Go", "l1", 1, 0, None), ("p", "t", "MAIN_TASK", 'A & <b> "c"', "l1", 2, 1, "a1"), ("p", "c", "CONFIRMATION_TASK", "Sign", "l2", 3, 2, "a1"), ("p", "g", "GATEWAY_XOR", "", "l2", 4, 3, None), ("p", "k", "INTERMEDIATE_LINK_THROW", "x'y", "l2", 5, 4, None),
         ("p", "w", "INTERMEDIATE_TIMER_CATCH", "wait", "l1", 6, 4, None), ("p", "e", "END_EVENT", "End", "l1", 7, 5, None)]
FLOWS = [("p", "f1", "s", "t", None, None, None, False), ("p", "f2", "t", "c", "form.x", "GREATER_THAN_OR_EQUAL", "5 < 6", False), ("p", "f3", "c", "g", "ok", "IS_TRUE", None, False), ("p", "f4", "g", "t", None, None, None, True), ("p", "f5", "g", "e", "ok", "CONTAINS", "&", False)]


def text(spark):
    lanes = spark.createDataFrame([("p", "l1", "One", "r1", 1), ("p", "l2", "Two & more", "r2", 2)], "g string, lane string, name string, role string, pos int")
    nodes = spark.createDataFrame(NODES, "g string, node string, node_type string, name string, lane string, pos int, rank int, activity string")
    flows = spark.createDataFrame(FLOWS, "g string, edge string, src string, dst string, source_output string, operator string, value string, back boolean")
    cards = spark.createDataFrame([("p", "P <1>"), ("q", "no parts")], "g string, name string")
    return {r["g"]: r["xml"] for r in interchange.written(cards, lanes, nodes, flows).collect()}


def test_what_is_written_is_read_back(spark):
    xml = text(spark)
    assert ET.fromstring(xml["q"]) is not None  # a card without parts is a file, too
    found = interchange.parsed(spark.createDataFrame([("p", xml["p"])], "doc string, text string"))
    nodes = {r["node"]: r for r in interchange.typed(found).collect()}
    assert {(r["node"], r["node_type"], r["name"], r["lane"], r["activity"]) for r in nodes.values()} == {(n, t, name or n, lane, a) for _, n, t, name, lane, _, _, a in NODES}
    assert all(len(r["bounds"]) == 4 and None not in r["bounds"] for r in nodes.values())
    flows = {r["flow"]: r for r in interchange.flows_of(found).collect()}
    told = {k: (r["src"], r["dst"], *(r["condition"] or (None, None, None))) for k, r in flows.items()}
    assert told == {k: (s, d, o, op, v) for _, k, s, d, o, op, v, _ in FLOWS}
    assert {k: len(r["points"]) for k, r in flows.items()} == {"f1": 4, "f2": 4, "f3": 4, "f4": 6, "f5": 4}
    start = nodes["s"]["bounds"]
    assert flows["f1"]["points"][0] == (start[0] + start[2], start[1] + start[3] / 2)
    root = ET.fromstring(xml["p"])
    assert [e.get("name") for e in root.iter() if e.tag.endswith("linkEventDefinition")] == ["x'y"]
    assert [len([c for c in e if c.tag.endswith(w)]) for w in ("incoming", "outgoing") for e in root.iter() if e.get("id") == "t"] == [2, 1]


def test_stages_see_what_earlier_ones_let_pass(spark):
    xml = text(spark)["p"]
    end = "  </bpmn:process>"
    call, twice, lost = '<bpmn:callActivity id="z"/>', '<bpmn:task id="t"/>', '<bpmn:sequenceFlow id="f9" sourceRef="t"/>'
    docs = [("good", xml), ("null", None), ("type", "<!DOCTYPE a>" + xml), ("broken", xml[:-5])]
    docs += [(k, xml.replace(end, v + end)) for k, v in (("call", call + twice + lost), ("twice", twice + lost), ("lost", lost))]
    found = interchange.verdicts(interchange.parsed(spark.createDataFrame(docs, "doc string, text string")))
    rows = {r["doc"]: (r["blocked"], r["reason"], r["details"]) for r in found.collect()}
    assert rows["good"] == (False, None, []) and {k: rows[k][1] for k in ("null", "type", "broken")} == dict.fromkeys(("null", "type", "broken"), "UNREADABLE")
    assert rows["call"] == (True, "UNSUPPORTED", ["UNSUPPORTED_CALLACTIVITY z"]) and rows["twice"] == (True, "DUPLICATE", ["t"]) and rows["lost"] == (True, "DANGLING", ["f9 -"])


def test_a_batch_is_aligned(spark):
    card, acts, flow = alignment.CARD, alignment.CATALOG, alignment.FLOW
    rows = [
        (1, card, "INPUT", "other", "b1", "doc", "Check  IT", None, None, None, ["1"]), (2, card, "PROCESS_NAME", "main.1", None, "Name", None, None, None, None, ["2"]), (3, card, "END_EVENT", "m", "x1", "Refused", None, None, None, None, ["3"]),
        (4, card, "START_EVENT", "m", "s0", "Go（开始）", None, None, None, None, ["4"]), (5, acts, "ACTIVITY", "m", "a1", "check it", None, None, None, None, ["5"]), (6, acts, "OUTPUT", "m", "a1", "paper", None, None, None, None, ["6", "5"]),
        (7, acts, "ACTIVITY", "m", "a2", "RE FUSED", None, None, None, None, ["7"]), (8, acts, "ACTIVITY", "m", "a3", "refused", None, None, None, ["tool"], ["8"]), (9, flow, "END_EVENT", "m", "e1", "Refused（结束）", None, None, None, None, ["9"]),
        (10, flow, "END_EVENT", "m", "e2", "Refused", None, None, None, None, ["10"]), (11, flow, "START_EVENT", "m", "s1", "Go", None, None, None, None, ["11"]), (12, flow, "FLOW", "m", "f", "", None, "s0", "b1", None, ["12"]),
    ]
    df = spark.createDataFrame([("g", "v", *r) for r in rows] + [("h", "v", *rows[4])], "g string, batch_sha256 string, pos long, task_kind string, kind string, process_key string, subject_key string, label string, activity string, src string, dst string, tools array<string>, evidence_refs array<string>")
    found = {r["pos"]: r for r in alignment.align(df).collect()}
    assert sorted(found) == [1, 2, 3, 5, 8, 9, 11, 12] and {r["process_key"] for r in found.values()} == {"main.1"}
    assert (found[5]["outputs"], found[5]["evidence_refs"]) == (["paper"], ["5", "6"])
    assert (found[9]["label"], found[9]["evidence_refs"]) == ("Refused", ["9", "7", "10"])  # the activity that only repeats the label, and the second event of that label
    assert found[3]["subject_key"] == "e2" and (found[11]["subject_key"], found[11]["evidence_refs"]) == ("s1", ["4", "11"])
    assert (found[12]["src"], found[12]["dst"]) == ("s1", "a1")
    assert [tuple(r) for r in alignment.problems(df).collect()] == [("h", "NO_PROCESS_CARD")]


def test_a_task_writes_so_many_lines_and_bindings_parse_once(spark, monkeypatch):
    whole = text(spark)
    monkeypatch.setattr(interchange, "TASK_LINES", 1)
    lanes = spark.createDataFrame([("p", "l1", "One", "r1", 1), ("p", "l2", "Two & more", "r2", 2)], "g string, lane string, name string, role string, pos int")
    nodes = spark.createDataFrame(NODES, "g string, node string, node_type string, name string, lane string, pos int, rank int, activity string")
    flows = spark.createDataFrame(FLOWS, "g string, edge string, src string, dst string, source_output string, operator string, value string, back boolean")
    told = interchange.written(spark.createDataFrame([("p", "P <1>"), ("q", "no parts")], "g string, name string"), lanes, nodes, flows)
    assert told.rdd.getNumPartitions() == 1 + len(NODES) + len(FLOWS) and {r["g"]: r["xml"] for r in told.collect()} == whole
    found = interchange.typed(interchange.parsed(told.selectExpr("g AS doc", "xml AS text")))
    bound = interchange.bindings(found, spark.createDataFrame([("p", "a1", 'A & <b> "c"')], "doc string, activity string, name string"))
    assert "MapInArrow" not in bound._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in bound.collect()] == [("p", "a1", "t", "c")]


def test_whole_numbers_are_coordinates_as_others_are(spark):
    values = [0.0, -0.0, 1.0, -7.0, 100.0, 0.5, 2.345, -0.001, 1e14, 1e15, 1e20, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    slow = "regexp_replace(regexp_replace(format_string('%.2f', v), '0+$', ''), '[.]$', '')"
    assert all(a == b for a, b in df.select(C.coordinate(F.col("v")), F.expr(slow)).collect())
