"""BPMN files with diagrams, written and read: models are rendered with shapes and edges of their layout, and texts are read back into models.

Reading checks a text in stages: elements that no model has, identifiers that are there twice, flows that lead nowhere. A text that one stage finds fault
with is blocked with that reason, and later stages leave it out. What is written is read back as it was.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procloom import workers
from procloom.functions import columns as C
from procloom.operators import graph, render
from procloom.sources import diagrams
from procloom.tables import spill

#: Node types with the tags that they are written as, and event definitions of those that have one.
TAGS = {
    "MAIN_TASK": "task", "CONFIRMATION_TASK": "userTask", "GATEWAY_XOR": "exclusiveGateway", "GATEWAY_AND": "parallelGateway", "GATEWAY_OR": "inclusiveGateway",
    "START_EVENT": "startEvent", "END_EVENT": "endEvent", "INTERMEDIATE_MESSAGE_CATCH": "intermediateCatchEvent", "INTERMEDIATE_MESSAGE_THROW": "intermediateThrowEvent",
    "INTERMEDIATE_TIMER_CATCH": "intermediateCatchEvent", "INTERMEDIATE_LINK_CATCH": "intermediateCatchEvent", "INTERMEDIATE_LINK_THROW": "intermediateThrowEvent",
}
DEFINITIONS = {k: k.split("_")[1].lower() for k in TAGS if k.startswith("INTERMEDIATE_")}
#: Elements that are nodes of a process, of which no model has the second kind.
KNOWN = sorted(set(TAGS.values()))
UNKNOWN = [
    "serviceTask", "scriptTask", "businessRuleTask", "sendTask", "receiveTask", "manualTask", "callActivity", "subProcess", "complexGateway", "eventBasedGateway", "boundaryEvent",
    "dataObject", "dataStoreReference", "textAnnotation", "group",
]
_SPACES = {"bpmn": "BPMN/20100524/MODEL", "bpmndi": "BPMN/20100524/DI", "dc": "DD/20100524/DC", "di": "DD/20100524/DI"}
#: Nodes and flows whose lines one task joins; a process's are never parted.
TASK_LINES = 25_000
#: What a lane's shape and the pool's are wider or higher than their contents.
LANE_X, POOL_PAD, RIGHT_PAD = 0, 10, 60


def _esc(c: Column | str) -> Column:
    return C.xml_escape(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _text(*parts: Column | str) -> Column:
    """Parts in a row; strings stand for themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(rows: DataFrame, by: list[str], order: Column, line: Column, name: str, tasks: int = 0) -> DataFrame:
    """by, name: the lines of rows joined in order. One process's lines make one text. With tasks, rows meet in so many by g before they become text, and texts don't move."""
    rows = rows.repartition(tasks, "g") if tasks else rows
    return rows.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("t"))))["t"], "\n").alias(name))


def _bounds(*values: Column) -> Column:
    values = tuple(v.cast("double") for v in values)
    return _text('        <dc:Bounds x="', C.coordinate(values[0]), '" y="', C.coordinate(values[1]), '" width="', C.coordinate(values[2]), '" height="', C.coordinate(values[3]), '" />')


def lane_places(nodes: DataFrame, lanes: DataFrame, places: DataFrame) -> DataFrame:
    """g, lane, pos, x, y, width, height of lanes, all as wide as the process needs."""
    sizes = nodes.select("g", "node", "lane", "rank").join(places, ["g", "node"])
    stacks = sizes.groupBy("g", "lane", "rank").agg((F.sum("height") + (F.count("*") - 1) * graph.STACK_GAP).alias("total"))
    high = lanes.select("g", "lane", "pos").join(stacks.groupBy("g", "lane").agg(F.max("total").alias("most")), ["g", "lane"], "left")
    high = high.withColumn("height", F.greatest(F.coalesce("most", F.lit(0)) + graph.LANE_PAD, F.lit(graph.LANE_LEAST)))
    above = Window.partitionBy("g").orderBy("pos", "lane").rowsBetween(Window.unboundedPreceding, -1)
    wide = sizes.groupBy("g").agg((F.max(F.col("x") + F.col("width")) + RIGHT_PAD).alias("width"))
    high = high.withColumn("y", F.coalesce(F.sum("height").over(above), F.lit(0))).join(wide, "g", "left")
    return high.select("g", "lane", "pos", F.lit(LANE_X).alias("x"), "y", F.coalesce("width", F.lit(800)).alias("width"), "height")


def written(cards: DataFrame, lanes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """g, xml of cards (g, name), lanes (g, lane, name, role, pos), nodes (g, node, node_type, name, lane, pos, rank, activity) and flows (g, edge, src, dst, source_output,
    operator, value, back)."""
    nodes, flows, lanes = spill(nodes, "nodes"), spill(flows, "flows"), spill(lanes, "lanes")  # several parts of a file read them
    places = spill(graph.layout(nodes, lanes), "places")
    routes = graph.routes(places, flows)
    rows = spill(lane_places(nodes, lanes, places), "lane_places")
    tasks = 1 + (nodes.count() + flows.count()) // TASK_LINES  # a task holds as much text in a large table as in a small one
    tag = F.create_map(*[F.lit(x) for p in TAGS.items() for x in p])[F.col("node_type")]
    held = _lines(nodes, ["g", "lane"], F.struct("pos", "node"), _text("        <bpmn:flowNodeRef>", _esc("node"), "</bpmn:flowNodeRef>"), "refs")
    lane = _text('      <bpmn:lane id="', _esc("lane"), '" name="', _esc("name"), '" model:roleId="', _esc("role"), '">\n', F.coalesce(F.concat("refs", F.lit("\n")), F.lit("")), "      </bpmn:lane>")
    lane_text = _lines(lanes.join(held, ["g", "lane"], "left"), ["g"], F.struct("pos", "lane"), lane, "lanes", tasks)

    ends = lambda side, word: _lines(flows, ["g", side], F.struct("edge"), _text(f"      <bpmn:{word}>", _esc("edge"), f"</bpmn:{word}>"), word).withColumnRenamed(side, "node")
    definition = F.create_map(*[F.lit(x) for p in DEFINITIONS.items() for x in p])[F.col("node_type")]
    event = F.when(definition == "link", _text('      <bpmn:linkEventDefinition name="', _esc("name"), '" />')).when(definition.isNotNull(), _text("      <bpmn:", definition, "EventDefinition />"))
    activity = F.when(F.col("activity").isNotNull(), _text(' model:activityId="', _esc("activity"), '"')).otherwise("")
    node = F.concat_ws("\n", _text("    <bpmn:", tag, ' id="', _esc("node"), '" name="', _esc("name"), '"', activity, ">"), F.col("incoming"), F.col("outgoing"), event, _text("    </bpmn:", tag, ">"))
    told = nodes.join(ends("dst", "incoming"), ["g", "node"], "left").join(ends("src", "outgoing"), ["g", "node"], "left")
    node_text = _lines(told, ["g"], F.struct("pos", "node"), node, "nodes", tasks)

    head = _text('    <bpmn:sequenceFlow id="', _esc("edge"), '" sourceRef="', _esc("src"), '" targetRef="', _esc("dst"), '"')
    condition = _text("      <bpmn:conditionExpression xsi:type=\"bpmn:tFormalExpression\">", _esc(render.condition_text(F.col("source_output"), F.col("operator"), F.coalesce("value", F.lit("")))), "</bpmn:conditionExpression>")
    flow = F.when(F.col("operator").isNull(), F.concat(head, F.lit(" />"))).otherwise(F.concat_ws("\n", F.concat(head, F.lit(">")), condition, F.lit("    </bpmn:sequenceFlow>")))
    flow_text = _lines(flows, ["g"], F.struct("edge"), flow, "flows", tasks)

    shape = lambda key, more: _text('      <bpmndi:BPMNShape id="Shape_', _esc(key), '" bpmnElement="', _esc(key), '"', more, ">\n", _bounds(F.col("x"), F.col("y"), F.col("width"), F.col("height")), "\n      </bpmndi:BPMNShape>")
    lane_shapes = _lines(rows, ["g"], F.struct("pos", "lane"), shape("lane", ' isHorizontal="true"'), "lane_shapes", tasks)
    marker = F.when(F.col("node_type").startswith("GATEWAY"), ' isMarkerVisible="true"').otherwise("")
    placed = nodes.select("g", "node", "node_type", "pos").join(places, ["g", "node"])
    node_shapes = _lines(placed, ["g"], F.struct("pos", "node"), shape("node", marker), "node_shapes", tasks)
    points = F.array_join(F.transform("points", lambda p: _text('        <di:waypoint x="', C.coordinate(p["x"]), '" y="', C.coordinate(p["y"]), '" />')), "\n")
    edge = _text('      <bpmndi:BPMNEdge id="Edge_', _esc("edge"), '" bpmnElement="', _esc("edge"), '">\n', points, "\n      </bpmndi:BPMNEdge>")
    edges = _lines(routes, ["g"], F.struct("edge"), edge, "edges", tasks)
    pool = rows.repartition(tasks, "g").groupBy("g").agg((F.min("x") - POOL_PAD).alias("px"), (F.min("y") - POOL_PAD).alias("py"), (F.max("width") + 2 * POOL_PAD).alias("pw"), (F.sum("height") + 2 * POOL_PAD).alias("ph"))

    whole = cards.repartition(tasks, "g")
    for part in (lane_text, node_text, flow_text, lane_shapes, node_shapes, edges, pool):
        whole = whole.join(part, "g", "left")
    spaces = " ".join(f'xmlns:{k}="http://www.omg.org/spec/{v}"' for k, v in _SPACES.items())
    pool_shape = F.when(F.col("px").isNotNull(), _text('      <bpmndi:BPMNShape id="Shape_Participant_1" bpmnElement="Participant_1" isHorizontal="true">\n', _bounds(F.col("px"), F.col("py"), F.col("pw"), F.col("ph")), "\n      </bpmndi:BPMNShape>"))
    xml = F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit(f'<bpmn:definitions {spaces} xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:model="urn:procloom:model" targetNamespace="http://bpmn.io/schema/bpmn">'),
        F.lit('  <bpmn:collaboration id="Collaboration_1">'), _text('    <bpmn:participant id="Participant_1" name="', _esc("name"), '" processRef="Process_', _esc("g"), '" />'), F.lit("  </bpmn:collaboration>"),
        _text('  <bpmn:process id="Process_', _esc("g"), '" isExecutable="false">'), F.when(F.col("lanes").isNotNull(), _text('    <bpmn:laneSet id="LaneSet_1">\n', F.col("lanes"), "\n    </bpmn:laneSet>")), F.col("nodes"), F.col("flows"), F.lit("  </bpmn:process>"),
        F.lit('  <bpmndi:BPMNDiagram id="BPMNDiagram_1">'), F.lit('    <bpmndi:BPMNPlane id="BPMNPlane_1" bpmnElement="Collaboration_1">'), pool_shape, F.col("lane_shapes"), F.col("node_shapes"), F.col("edges"),
        F.lit("    </bpmndi:BPMNPlane>"), F.lit("  </bpmndi:BPMNDiagram>"), F.lit("</bpmn:definitions>"),
    )
    return whole.select("g", xml.alias("xml"))


_ROW = "doc string, part string, pos int, id string, tag string, name string, definition string, activity string, role string, lane string, source_ref string, target_ref string, condition string, bounds array<double>, points array<struct<x: double, y: double>>"


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<struct<x: double, y: double>>": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))}
_SCHEMA = pa.schema([(n, _ARROW[kind]) for n, kind in (f.split(" ", 1) for f in _ROW.replace(", y:", ",y:").split(", ")) for kind in [kind.replace(",y:", ", y:")]])


@cache
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _tag(e: ET.Element) -> str:
    return _local(e.tag)


def _value(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


_number = lru_cache(1 << 16)(diagrams.decimal)  # coordinates repeat
_TOLD = {*KNOWN, *UNKNOWN, "lane", "sequenceFlow"}


def _rows(doc: str, root: ET.Element) -> Iterator[dict]:
    """Nodes, lanes and flows of one file, as they are."""
    tagged = [(e, _tag(e)) for e in root.iter()]
    lane = {(r.text or "").strip(): e.get("id") for e, tag in tagged if tag == "lane" for r in e if _tag(r) == "flowNodeRef"}
    drawn = {e.get("bpmnElement"): e for e, tag in tagged if tag in ("BPMNShape", "BPMNEdge") and e.get("bpmnElement")}
    for pos, (e, tag) in enumerate(tagged):
        if tag not in _TOLD:
            continue
        key = e.get("id")
        base = {"doc": doc, "pos": pos, "id": key, "tag": tag, "name": e.get("name")}
        at = list(drawn.get(key, ()))
        if tag in KNOWN or tag in UNKNOWN or tag == "lane":
            box = next((c for c in at if _tag(c) == "Bounds"), None)
            bounds = [_number(box.get(k)) for k in ("x", "y", "width", "height")] if box is not None else None
            definition = next((_tag(c).removesuffix("EventDefinition") for c in e if _tag(c).endswith("EventDefinition")), None)
            part = "LANE" if tag == "lane" else "NODE"
            yield base | {"part": part, "definition": definition, "activity": _value(e, "activityId"), "role": _value(e, "roleId"), "lane": lane.get(key), "bounds": bounds}
        elif tag == "sequenceFlow":
            text = next(("".join(c.itertext()) for c in e if _tag(c) == "conditionExpression"), None)
            points = [{"x": _number(c.get("x")), "y": _number(c.get("y"))} for c in at if _tag(c) == "waypoint"]
            yield base | {"part": "FLOW", "source_ref": e.get("sourceRef"), "target_ref": e.get("targetRef"), "condition": text, "points": points}


def parsed(docs: DataFrame) -> DataFrame:
    """What BPMN texts (doc, text) hold, one row a node, lane or flow; part ERROR for a text that isn't parsed, with the reason as name."""
    workers.ship(docs.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc, text, bad in zip(*(batch.column(c) for c in ("doc", "text", "bad"))):
                name = bad.as_py()
                try:
                    root = None if name else ET.fromstring(text.as_py())
                except ET.ParseError as e:
                    name = str(e)
                if name:
                    yield {"doc": doc.as_py(), "part": "ERROR", "name": name}
                else:
                    yield from _rows(doc.as_py(), root)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from workers.handed(told(batches), _SCHEMA)

    bad = F.when(F.col("text").isNull(), "no text").when(diagrams.unsafe_xml(F.col("text")), "a document type or entities are declared")
    return docs.select("doc", "text", bad.alias("bad")).mapInArrow(parse, _ROW)


def typed(found: DataFrame) -> DataFrame:
    """The nodes among parsed rows: doc, pos, node, node_type, name (the identifier if there is none), lane, activity, definition, bounds."""
    own = F.create_map(*[F.lit(x) for k, t in TAGS.items() if k not in DEFINITIONS for x in (t, k)])[F.col("tag")]
    side = F.when(F.col("tag") == "intermediateCatchEvent", "CATCH").when(F.col("tag") == "intermediateThrowEvent", "THROW")
    kind = F.concat(F.lit("INTERMEDIATE_"), F.upper(F.coalesce("definition", F.lit("message"))), F.lit("_"), side)
    node_type = F.coalesce(own, F.when(kind.isin(*DEFINITIONS), kind), F.concat(F.lit("UNSUPPORTED_"), F.upper("tag")))
    return found.where("part = 'NODE'").select("doc", "pos", F.col("id").alias("node"), node_type.alias("node_type"), F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), "lane", "activity", "definition", "bounds")


def flows_of(found: DataFrame) -> DataFrame:
    """doc, pos, flow, src, dst, condition (struct; null without one), points of the flows among parsed rows. What isn't an operator between words is all value."""
    told = render.parse_condition(C.xml_escape(F.col("condition")))
    return found.where("part = 'FLOW'").select("doc", "pos", F.col("id").alias("flow"), F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"), F.when(F.col("condition").isNotNull(), told).alias("condition"), "points")


def verdicts(found: DataFrame) -> DataFrame:
    """doc, blocked, reason (UNREADABLE, UNSUPPORTED, DUPLICATE, DANGLING or null), details (sorted) of each text among parsed rows; a stage sees only what the ones before it let pass."""
    found = spill(found, "parsed")
    nodes, flows = typed(found), flows_of(found)
    every = found.select("doc").distinct()
    stages = [("UNREADABLE", found.where("part = 'ERROR'").select("doc", F.col("name").alias("detail"))), ("UNSUPPORTED", nodes.where("node_type like 'UNSUPPORTED%'").select("doc", F.concat_ws(" ", "node_type", "node").alias("detail")))]
    stages.append(("DUPLICATE", nodes.groupBy("doc", "node").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.col("node").alias("detail"))))
    ends = flows.select("doc", "flow", F.explode(F.array("src", "dst")).alias("node"))
    stages.append(("DANGLING", ends.join(nodes.select("doc", "node").distinct(), ["doc", "node"], "left_anti").select("doc", F.concat_ws(" ", "flow", F.coalesce("node", F.lit("-"))).alias("detail"))))
    out, passed = [], every
    for reason, rows in stages:
        bad = spill(rows.join(passed, "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list("detail")).alias("details")), "faults")  # of one file
        out.append(bad.select("doc", F.lit(True).alias("blocked"), F.lit(reason).alias("reason"), "details"))
        passed = passed.join(bad, "doc", "left_anti")
    whole = passed.select("doc", F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("details"))
    for part in out:
        whole = whole.unionByName(part)
    return whole


def bindings(nodes: DataFrame, activities: DataFrame) -> DataFrame:
    """doc, activity, main_task, confirmation_task: the first main task of an activity's name, and the first confirmation task that names the activity (doc, activity, name)."""
    nodes = spill(nodes.where("node_type in ('MAIN_TASK', 'CONFIRMATION_TASK')").select("doc", "pos", "node", "node_type", "name", "activity"), "tasks")  # texts are parsed once
    first = lambda kind, key: nodes.where(F.col("node_type") == kind).groupBy("doc", key).agg(F.min_by("node", "pos").alias("task"))
    main = first("MAIN_TASK", "name").withColumnRenamed("task", "main_task")
    confirm = first("CONFIRMATION_TASK", "activity").withColumnRenamed("task", "confirmation_task")
    return activities.join(main, ["doc", "name"]).join(confirm, ["doc", "activity"], "left").select("doc", "activity", "main_task", "confirmation_task")
