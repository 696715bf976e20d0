from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procloom.operators import facts, findings, graph, render, rules, state
from procloom.plans import models as M
from procloom.sources import diagrams

from .oracle import rows

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_facts_does_not_matter(spark, seed):
    own = M.FACTS.df(spark)
    shuffled = own.orderBy(F.rand(seed)).repartition(3)
    for f in (facts.dedup_facts, facts.activity_aggregates, facts.resolve_flows, facts.role_lanes):
        assert rows(f(own)) == rows(f(shuffled))


def test_a_spaced_role_finds_its_lane(spark):
    found = {r["role"]: (r["lane_id"], r["question_id"]) for r in facts.role_lanes(M.FACTS.df(spark)).where("process = 'CM-1-4'").collect()}
    assert found["申请人"][1] is None and found["经理"][1] is None


def back_by_hand(nodes, edges):
    out, state_of, found = {n: [d for s, d in edges if s == n] for n in nodes}, dict.fromkeys(nodes, 0), set()

    def visit(n):
        state_of[n] = 1
        for d in out[n]:
            if state_of[d] == 1:
                found.add((n, d))
            elif not state_of[d]:
                visit(d)
        state_of[n] = 2

    for n in nodes:
        if not state_of[n]:
            visit(n)
    return found


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=14, unique=True))
def test_back_edges_and_ranks(spark, edges):
    nodes = list("abcdef")
    n = spark.createDataFrame([("g", x, k) for k, x in enumerate(nodes)], "g string, node string, pos int")
    e = spark.createDataFrame([("g", s, d, k) for k, (s, d) in enumerate(edges)], "g string, src string, dst string, pos int")
    back = {(r["src"], r["dst"]) for r in graph.back_edges(n, e).collect()}
    assert back == back_by_hand(nodes, edges)
    forward = [x for x in edges if x not in back]
    depth = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for s, d in forward:
            depth[d] = max(depth[d], depth[s] + 1)
    rest = spark.createDataFrame([("g", s, d) for s, d in forward], "g string, src string, dst string")
    assert {r["node"]: r["rank"] for r in graph.ranks(n, rest).collect()} == depth


def test_mermaid_first_label_counts_and_bad_lines_are_told(spark):
    nodes, flows, lost = diagrams.mermaid(M.MERMAID.df(spark))
    assert {(r["node_id"], r["name"], r["subgraph"]) for r in nodes.where("doc = 'm1'").collect()} == {("A", "Start here", None), ("B", "Good?", None), ("C", "Ship", None), ("D", "D", "Back office"), ("E", "Alone", None)}
    assert [r["line"] for r in lost.collect()] == ["!!! what"]
    assert flows.where("doc = 'm2'").count() == 0


def test_bpmn_elements(spark):
    found = {r["id"]: r for r in diagrams.bpmn(M.BPMN.df(spark)).where("doc = 'b1'").collect()}
    assert found["T1"]["type"] == "TASK" and found["T1"]["lane_id"] == "L1"
    assert found["F3"]["is_default"] and found["F3"]["condition"] == "a > 1" and not found["F1"]["is_default"]
    assert diagrams.bpmn(M.BPMN.df(spark)).where("doc = 'b2'").first()["name"] == "a document type or entities are declared"
    assert diagrams.bpmn(M.BPMN.df(spark)).where("doc = 'b3'").first()["part"] == "WARNING"


def test_svg_shapes_once_each(spark):
    assert sorted((r["sub_type"], r["name"]) for r in diagrams.svg(M.SVG.df(spark)).collect()) == [("circle", ""), ("rect", ""), ("text", "Hi there")]


def test_written_bpmn_is_read_back(spark):
    xml = render.bpmn_xml(M.CARDS.df(spark), M.LANES.df(spark), M.NODES.df(spark), M.FLOWS.df(spark)).select(F.col("g").alias("doc"), F.col("xml").alias("text"))
    parts = diagrams.bpmn(xml)
    wanted = M.NODES.df(spark).select("g", "node")
    got = parts.where("part = 'ELEMENT' and type <> 'LANE'").select(F.col("doc").alias("g"), F.col("id").alias("node"))
    assert rows(got) == rows(wanted)
    assert parts.where("id = 'e4'").first()["condition"] == "amount > 5 & < 9"


def test_empty_models_have_no_findings(spark):
    empty = {k: spark.createDataFrame([], getattr(M, k).schema) for k in ("TREE", "NODES", "FLOWS", "LANES", "BINDINGS", "ACTIVITIES", "CARDS")}
    assert rules.architecture_rules(empty["TREE"]).count() == 0
    assert rules.bpmn_rules(empty["NODES"], empty["FLOWS"]).count() == 0
    assert rules.draft_gates(empty["CARDS"], empty["ACTIVITIES"], empty["BINDINGS"], empty["NODES"], empty["FLOWS"], empty["LANES"]).count() == 0


def test_verdicts(spark):
    found = findings.collect(findings.visual_policy(M.FINDINGS.df(spark)))
    assert {r["run_id"]: r["verdict"] for r in findings.verdicts(M.STAGES.df(spark), found).collect()} == {"r1": "CONDITIONAL_PASS", "r2": "CONDITIONAL_PASS", "r3": "INSUFFICIENT_EVIDENCE", "r4": "PASS", "r5": "INSUFFICIENT_EVIDENCE"}


def test_conditions_that_have_no_form(spark):
    df = spark.createDataFrame([("whenever it fits",), ("a &gt;= &quot;3&quot;",), (None,)], "t string").select(render.parse_condition(F.col("t")).alias("c")).collect()
    assert tuple(df[0]["c"]) == (None, None, "whenever it fits")
    assert tuple(df[1]["c"]) == ("a", "GREATER_THAN_OR_EQUAL", "3")
    assert tuple(df[2]["c"]) == (None, None, None)


def test_retries_stop_after_three(spark):
    rows_ = [(1, 1, "RETRY", "SCHEMA"), (1, 2, "ACCEPT", None), (2, 1, "RETRY", "A"), (2, 2, "RETRY", "B"), (2, 3, "RETRY", "C"), (2, 4, "ACCEPT", None), (3, 1, "RETRY", "A")]
    df = spark.createDataFrame(rows_, "task long, attempt int, verdict string, category string")
    assert {r["task"]: (r["outcome"], r["n_attempts"], r["category"]) for r in state.task_outcomes(df).collect()} == {1: ("ACCEPTED", 2, None), 2: ("FAILED", 3, "C"), 3: ("PENDING", 1, "A")}
