"""Queries that write models of events as BPMN files and read them back, and others on models of given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procloom.operators import alignment, graph, interchange, providers, schemas
from procloom.plans.registry import Registry, table
from procloom.plans.text_queries import tokens_sql
from procloom.tables import spill

R = Registry()

_TYPES = {"view": "MAIN_TASK", "click": "CONFIRMATION_TASK", "error": "GATEWAY_XOR", "signup": "INTERMEDIATE_TIMER_CATCH"}
_OTHER = "INTERMEDIATE_LINK_THROW"


def models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cards, lanes, nodes and flows: a process for each user, whose events follow each other in lanes of their types; every tenth leads back to the first."""
    user = Window.partitionBy("user_id")
    order = user.orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"n": F.row_number().over(order), "next": F.lead("event_id").over(order), "first": F.first("event_id").over(order), "most": F.count("*").over(user)})
    node_type = F.lit(_OTHER)
    for k, v in _TYPES.items():
        node_type = F.when(F.col("event_type") == k, v).otherwise(node_type)
    node_type = F.when(F.col("n") == 1, "START_EVENT").when(F.col("n") == F.col("most"), "END_EVENT").otherwise(node_type)
    key = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    g, lane = F.col("user_id").cast("string").alias("g"), F.concat(F.lit("L_"), "event_type")
    activity = F.when(node_type.isin("MAIN_TASK", "CONFIRMATION_TASK"), F.concat(F.lit("A"), F.col("event_id").cast("string")))
    nodes = e.select(g, key("event_id").alias("node"), node_type.alias("node_type"), F.col("props").alias("name"), lane.alias("lane"), F.col("n").alias("pos"), (F.col("n") - 1).alias("rank"), activity.alias("activity"))
    lanes = e.select(g, lane.alias("lane"), F.col("event_type").alias("name"), F.concat(F.lit("role & "), "event_type").alias("role"), F.lit(0).alias("pos")).distinct()
    some = F.col("value") > 100
    ahead = e.where("next is not null").select(
        g, F.concat(F.lit("F"), F.col("event_id").cast("string")).alias("edge"), key("event_id").alias("src"), key("next").alias("dst"), F.when(some, F.concat(F.lit("form."), "event_type")).alias("source_output"),
        F.when(some, "GREATER_THAN").alias("operator"), F.when(some, F.floor("value").cast("string")).alias("value"), F.lit(False).alias("back"),
    )
    back = e.where("n % 10 = 0").select(
        g, F.concat(F.lit("B"), F.col("event_id").cast("string")).alias("edge"), key("event_id").alias("src"), key("first").alias("dst"), F.lit("again").alias("source_output"), F.lit("IS_TRUE").alias("operator"),
        F.lit(None).cast("string").alias("value"), F.lit(True).alias("back"),
    )
    return e.select(g, F.concat(F.lit("User <"), F.col("user_id").cast("string"), F.lit(">")).alias("name")).distinct(), lanes, nodes, ahead.unionByName(back)


_CASE = "CASE WHEN n = 1 THEN 'START_EVENT' WHEN n = most THEN 'END_EVENT' " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in _TYPES.items()) + f" ELSE '{_OTHER}' END"
_PLACED = f"""
    e AS (SELECT *, row_number() OVER w AS n, lead(event_id) OVER w AS next, first_value(event_id) OVER w AS first, count(*) OVER (PARTITION BY user_id) AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT *, user_id::VARCHAR AS g, 'N' || event_id AS id, {_CASE} AS type FROM e),
    s AS (SELECT *, CASE WHEN contains(type, 'GATEWAY') THEN 50 WHEN regexp_matches(type, 'EVENT|CATCH|THROW') THEN 36 ELSE 120 END AS w, CASE WHEN contains(type, 'GATEWAY') THEN 50 WHEN regexp_matches(type, 'EVENT|CATCH|THROW') THEN 36 ELSE 80 END AS h FROM t),
    l AS (SELECT g, event_type, greatest(max(h) + 60, 150) AS lh, sum(greatest(max(h) + 60, 150)) OVER (PARTITION BY g ORDER BY event_type ROWS UNBOUNDED PRECEDING) - greatest(max(h) + 60, 150) AS ly FROM s GROUP BY 1, 2),
    p AS (SELECT s.*, lh, ly, 260 + (n - 1) * 200 + (120 - w) / 2 AS x, ly + (lh - h) / 2 AS y FROM s JOIN l USING (g, event_type))"""


@R.add(f"""
    WITH {_PLACED}, f AS (
        SELECT g, 'F' || event_id AS id, 'N' || event_id AS src, 'N' || next AS dst, CASE WHEN value > 100 THEN 'form.' || event_type END AS source_output, CASE WHEN value > 100 THEN 'GREATER_THAN' END AS operator,
            CASE WHEN value > 100 THEN floor(value)::BIGINT::VARCHAR END AS value, 4 AS n_points, x + w AS x, y + h / 2 AS y FROM p WHERE next IS NOT NULL
        UNION ALL SELECT g, 'B' || event_id, 'N' || event_id, 'N' || first, 'again', 'IS_TRUE', NULL, 6, x + w, y + h / 2 FROM p WHERE n % 10 = 0)
    SELECT g, 'NODE' AS part, id, type, props AS name, 'L_' || event_type AS lane, CASE WHEN type IN ('MAIN_TASK', 'CONFIRMATION_TASK') THEN 'A' || event_id END AS activity, NULL AS src, NULL AS dst, NULL AS source_output, NULL AS operator, NULL AS value,
        NULL::INTEGER AS n_points, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS width, h::DOUBLE AS height FROM p
    UNION ALL SELECT g, 'FLOW', id, NULL, NULL, NULL, NULL, src, dst, source_output, operator, value, n_points, x, y, NULL, NULL FROM f
    UNION ALL SELECT g, 'LANE', 'L_' || event_type, NULL, event_type, NULL, 'role & ' || event_type, NULL, NULL, NULL, NULL, NULL, NULL, 0, ly, (SELECT max(x + w) FROM p WHERE p.g = l.g) + 60, lh FROM l""")
def bpmn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processes of all users written as BPMN with diagrams, and read back."""
    found = spill(interchange.parsed(interchange.written(*models(spark, sf_dir)).select(F.col("g").alias("doc"), F.col("xml").alias("text"))), "parsed", by="part")  # each part reads its own rows
    none = lambda kind="string": F.lit(None).cast(kind)
    box = lambda b: [F.get(b, k).alias(c) for k, c in enumerate(("x", "y", "width", "height"))]
    nodes = interchange.typed(found).select(
        F.col("doc").alias("g"), F.lit("NODE").alias("part"), F.col("node").alias("id"), F.col("node_type").alias("type"), "name", "lane", "activity", *[none().alias(c) for c in ("src", "dst", "source_output", "operator", "value")],
        none("int").alias("n_points"), *box("bounds"),
    )
    point = F.get("points", 0)
    flows = interchange.flows_of(found).select(
        F.col("doc").alias("g"), F.lit("FLOW").alias("part"), F.col("flow").alias("id"), *[none().alias(c) for c in ("type", "name", "lane", "activity")], "src", "dst", "condition.source_output", "condition.operator", "condition.value",
        F.size("points").alias("n_points"), point["x"].alias("x"), point["y"].alias("y"), none("double").alias("width"), none("double").alias("height"),
    )
    lanes = found.where("part = 'LANE'").select(
        F.col("doc").alias("g"), "part", "id", none().alias("type"), "name", none().alias("lane"), F.col("role").alias("activity"), *[none().alias(c) for c in ("src", "dst", "source_output", "operator", "value")], none("int").alias("n_points"), *box("bounds"),
    )
    return nodes.unionByName(flows).unionByName(lanes)


_LOST = '<bpmn:sequenceFlow id="lost" sourceRef="nowhere" targetRef="none" />'
_CALL = '<bpmn:callActivity id="call" name="x" />'


@R.add("""
    WITH u AS (SELECT user_id, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY 1)
    SELECT user_id::VARCHAR AS doc, user_id % 6 > 0 AS blocked, CASE user_id % 6 WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'DUPLICATE' WHEN 3 THEN 'DANGLING' WHEN 4 THEN 'UNSUPPORTED' WHEN 5 THEN 'UNREADABLE' END AS reason,
        CASE user_id % 6 WHEN 1 THEN ['UNSUPPORTED_CALLACTIVITY call'] WHEN 2 THEN ['N' || first] WHEN 3 THEN ['lost none', 'lost nowhere'] WHEN 4 THEN ['UNSUPPORTED_CALLACTIVITY call'] WHEN 5 THEN ['a document type or entities are declared'] ELSE []::VARCHAR[] END AS details FROM u""")
def bpmn_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all users, five of six broken in one way or two."""
    cards, lanes, nodes, flows = models(spark, sf_dir)
    end, k = "  </bpmn:process>", F.col("g").cast("long") % 6
    first = nodes.where("pos = 1").select("g", F.concat(F.lit('<bpmn:task id="'), "node", F.lit('" />')).alias("again"))
    told = interchange.written(cards, lanes, nodes, flows).join(first, "g")
    add = F.when(k == 1, F.lit(_CALL)).when(k == 2, F.col("again")).when(k == 3, F.lit(_LOST)).when(k == 4, F.lit(_CALL + _LOST)).otherwise("")
    text = F.replace("xml", F.lit(end), F.concat(add, F.lit(end)))
    text = F.when(k == 5, F.replace(text, F.lit("<bpmn:definitions"), F.lit("<!DOCTYPE x><bpmn:definitions"))).otherwise(text)
    return interchange.verdicts(interchange.parsed(told.select(F.col("g").alias("doc"), text.alias("text"))))


@R.add("""
    WITH e AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT user_id, props, arg_min('N' || event_id, n) AS main_task FROM e WHERE n > 1 AND n < most AND event_type = 'view' GROUP BY 1, 2),
    c AS (SELECT user_id, event_id FROM e WHERE n > 1 AND n < most AND event_type = 'click')
    SELECT e.user_id::VARCHAR AS doc, 'A' || e.event_id AS activity, main_task, 'N' || c.event_id AS confirmation_task FROM e JOIN m USING (user_id, props) LEFT JOIN c ON c.user_id = e.user_id AND c.event_id = e.event_id""")
def task_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an activity that looks for its main task by name, and for its confirmation by identifier."""
    found = interchange.parsed(interchange.written(*models(spark, sf_dir)).select(F.col("g").alias("doc"), F.col("xml").alias("text")))
    activities = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc"), F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("activity"), F.col("props").alias("name"))
    return interchange.bindings(interchange.typed(found), activities)


def fragment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each user, whose events are facts of its fragments; one user in nine has no card, one in eleven two versions."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    t, r = F.col("event_type"), F.col("event_id") % 4
    fits = lambda *pairs: F.coalesce(*[F.when(c, v) for c, v in pairs])
    named = (t == "signup") & (F.col("event_id") % 7 == 0)
    kind = fits((named, "PROCESS_NAME"), (t == "signup", "INPUT"), (t == "view", "ACTIVITY"), (t == "click", "INPUT"), (t == "purchase", "FLOW"), (r < 2, "END_EVENT"), (r >= 2, "START_EVENT"))
    task = fits((t == "signup", "PROCESS_CARD"), (t.isin("view", "click"), "ACTIVITY_CATALOG"), (t == "purchase", "CONTROL_FLOW"), (r.isin(0, 3), "CONTROL_FLOW"), (F.lit(True), "PROCESS_CARD"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("k")
    subject = fits((t == "signup", text("b", k)), (t.isin("view", "click"), text("a", k)), (t == "purchase", text("f", F.col("event_id"))), (r == 0, text("e", k)), (r == 1, text("x", k)), (r == 2, text("s", k % 5)), (r == 3, text("t", k % 5)))
    label = fits((t == "view", text("Act ", k)), (t == "click", text("in", F.col("event_id"))), (r == 0, text("act", k, "（结束）")), (r == 1, text("act", k)), (r == 2, text("Go", k % 3, "（开始）")), (r == 3, text("Go", k % 3)))
    label = F.when(t.isin("signup", "purchase"), text("n", F.col("event_id"))).otherwise(label)
    flow = t == "purchase"
    src = F.when(flow & (F.col("event_id") % 3 == 0), text("s", k % 5)).when(flow, text("b", k))
    rows = e.select(
        F.col("user_id").cast("string").alias("g"), F.when((F.col("user_id") % 11 == 0) & (F.col("event_id") % 2 == 0), "v2").otherwise("v1").alias("batch_sha256"), task.alias("task_kind"), F.col("event_id").alias("pos"), kind.alias("kind"),
        text("p", F.col("user_id"), ".", k).alias("process_key"), subject.alias("subject_key"), label.alias("label"), F.when((t == "signup") & ~named, text("ACT  ", k)).alias("activity"), src.alias("src"), F.when(flow, text("b", (k + 1) % 100)).alias("dst"),
        F.when(k % 10 == 0, F.array(F.lit("tool"))).alias("tools"), F.array(text("B-", F.col("event_id")), text("B-", k)).alias("evidence_refs"), F.col("user_id"),
    )
    return rows.where("user_id % 9 > 0 or task_kind <> 'PROCESS_CARD'").drop("user_id")


_FRAGMENTS = """
    e AS (SELECT *, (props ->> '$.k')::INTEGER AS k, event_id % 4 AS r FROM events),
    f0 AS (SELECT user_id, user_id::VARCHAR AS g, CASE WHEN user_id % 11 = 0 AND event_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS sha,
        CASE WHEN event_type = 'signup' THEN 'PROCESS_CARD' WHEN event_type IN ('view', 'click') THEN 'ACTIVITY_CATALOG' WHEN event_type = 'purchase' OR r IN (0, 3) THEN 'CONTROL_FLOW' ELSE 'PROCESS_CARD' END AS task_kind, event_id AS pos,
        CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'PROCESS_NAME' ELSE 'INPUT' END WHEN 'view' THEN 'ACTIVITY' WHEN 'click' THEN 'INPUT' WHEN 'purchase' THEN 'FLOW' ELSE CASE WHEN r < 2 THEN 'END_EVENT' ELSE 'START_EVENT' END END AS kind,
        'p' || user_id || '.' || k AS process_key,
        CASE event_type WHEN 'signup' THEN 'b' || k WHEN 'view' THEN 'a' || k WHEN 'click' THEN 'a' || k WHEN 'purchase' THEN 'f' || event_id ELSE CASE r WHEN 0 THEN 'e' || k WHEN 1 THEN 'x' || k WHEN 2 THEN 's' || k % 5 ELSE 't' || k % 5 END END AS subject_key,
        CASE event_type WHEN 'signup' THEN 'n' || event_id WHEN 'purchase' THEN 'n' || event_id WHEN 'view' THEN 'Act ' || k WHEN 'click' THEN 'in' || event_id ELSE CASE r WHEN 0 THEN 'act' || k || '（结束）' WHEN 1 THEN 'act' || k WHEN 2 THEN 'Go' || k % 3 || '（开始）' ELSE 'Go' || k % 3 END END AS label,
        CASE WHEN event_type = 'signup' AND event_id % 7 > 0 THEN 'ACT  ' || k END AS activity, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 's' || k % 5 ELSE 'b' || k END END AS src,
        CASE WHEN event_type = 'purchase' THEN 'b' || (k + 1) % 100 END AS dst, k % 10 = 0 AS tooled, ['B-' || event_id, 'B-' || k] AS refs FROM e),
    f1 AS (SELECT * FROM f0 WHERE user_id % 9 > 0 OR task_kind <> 'PROCESS_CARD'),
    ok AS (SELECT g FROM f1 GROUP BY g HAVING count(DISTINCT sha) = 1 AND bool_or(task_kind = 'PROCESS_CARD')), f AS (SELECT * FROM f1 SEMI JOIN ok USING (g))"""


@R.add(f"WITH {_FRAGMENTS} SELECT g, CASE WHEN count(DISTINCT sha) > 1 THEN 'MIXED_BATCH' ELSE 'NO_PROCESS_CARD' END AS problem FROM f1 ANTI JOIN ok USING (g) GROUP BY g")
def alignment_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that can't be aligned."""
    return alignment.problems(fragment_facts(spark, sf_dir))


_DISTINCT = "list_filter({x}, lambda x, i: list_position({x}, x) = i)"


@R.add(f"""
    WITH {_FRAGMENTS}, key AS (SELECT g, arg_min(process_key, [(kind <> 'PROCESS_NAME')::INT, pos]) AS process_key FROM f WHERE task_kind = 'PROCESS_CARD' GROUP BY g),
    named AS (SELECT g, subject_key AS key, lower(regexp_replace(arg_max(activity, pos), '\\s+', '', 'g')) AS name FROM f WHERE task_kind = 'PROCESS_CARD' AND kind = 'INPUT' AND activity IS NOT NULL GROUP BY 1, 2),
    acts AS (SELECT g, lower(regexp_replace(label, '\\s+', '', 'g')) AS name, arg_min(subject_key, pos) AS own FROM f WHERE kind = 'ACTIVITY' GROUP BY 1, 2), map AS (SELECT g, key, own FROM named JOIN acts USING (g, name)),
    last AS (SELECT g, subject_key, max(pos) AS target FROM f WHERE kind = 'ACTIVITY' GROUP BY 1, 2),
    ins AS (SELECT f.g, target AS pos, list(label ORDER BY f.pos) AS inputs, flatten(list(refs ORDER BY f.pos)) AS more FROM f JOIN last USING (g, subject_key) WHERE task_kind = 'ACTIVITY_CATALOG' AND kind = 'INPUT' GROUP BY 1, 2),
    a AS (SELECT f.* EXCLUDE (refs), CASE WHEN kind = 'ACTIVITY' THEN coalesce(inputs, []) END AS inputs, {_DISTINCT.format(x='(refs || coalesce(more, []))')} AS refs FROM f LEFT JOIN ins USING (g, pos)
        WHERE NOT (task_kind = 'ACTIVITY_CATALOG' AND kind = 'INPUT' AND EXISTS (SELECT 1 FROM last WHERE last.g = f.g AND last.subject_key = f.subject_key))),
    b AS (SELECT *, trim(replace(replace(label, '（结束）', ''), '（开始）', '')) AS event FROM a),
    ends AS (SELECT g, event, min(pos) AS goal FROM b WHERE kind = 'END_EVENT' AND task_kind = 'CONTROL_FLOW' GROUP BY 1, 2),
    alias AS (SELECT b.g, b.pos, goal, refs FROM b JOIN ends ON ends.g = b.g AND ends.event = lower(replace(b.label, ' ', '')) WHERE b.kind = 'ACTIVITY' AND len(inputs) = 0 AND NOT tooled),
    more AS (SELECT g, goal AS pos, flatten(list(refs ORDER BY pos)) AS more FROM alias GROUP BY 1, 2),
    c AS (SELECT b.* EXCLUDE (refs), {_DISTINCT.format(x='(refs || coalesce(more, []))')} AS refs FROM b LEFT JOIN more USING (g, pos) ANTI JOIN alias ON alias.g = b.g AND alias.pos = b.pos),
    own AS (SELECT g, event, arg_max(subject_key, pos) AS own FROM c WHERE kind = 'END_EVENT' AND task_kind = 'CONTROL_FLOW' GROUP BY 1, 2),
    e1 AS (SELECT g, task_kind, event, min(pos) AS pos, flatten(list(refs ORDER BY pos)) AS every FROM c WHERE kind = 'END_EVENT' GROUP BY 1, 2, 3),
    s1 AS (SELECT g, event, coalesce(arg_min(subject_key, pos) FILTER (task_kind = 'CONTROL_FLOW'), min(subject_key)) AS own, flatten(list(refs ORDER BY pos)) AS every FROM c WHERE kind = 'START_EVENT' GROUP BY 1, 2),
    s2 AS (SELECT c.g, c.event, own, any_value(every) AS every, coalesce(min(pos) FILTER (subject_key = own), min(pos)) AS pos FROM c JOIN s1 USING (g, event) WHERE kind = 'START_EVENT' GROUP BY 1, 2, 3),
    moved AS (SELECT c.g, c.subject_key AS key, arg_max(s2.own, c.pos) AS own FROM c JOIN s2 ON s2.g = c.g AND s2.event = c.event WHERE kind = 'START_EVENT' AND c.pos <> s2.pos AND c.subject_key <> s2.own GROUP BY 1, 2),
    d AS (SELECT c.g, c.task_kind, c.pos, c.kind, CASE WHEN c.task_kind = 'PROCESS_CARD' AND c.kind = 'END_EVENT' THEN coalesce(own.own, subject_key) WHEN c.kind = 'START_EVENT' THEN s2.own ELSE subject_key END AS subject_key,
        CASE WHEN c.kind = 'END_EVENT' THEN replace(label, '（结束）', '') ELSE label END AS label, coalesce(ms.own, src) AS src, coalesce(md.own, dst) AS dst, inputs, coalesce(e1.every, s2.every, refs) AS refs
        FROM c LEFT JOIN e1 ON c.kind = 'END_EVENT' AND e1.g = c.g AND e1.pos = c.pos LEFT JOIN own ON c.kind = 'END_EVENT' AND own.g = c.g AND own.event = c.event LEFT JOIN s2 ON c.kind = 'START_EVENT' AND s2.g = c.g AND s2.pos = c.pos
        LEFT JOIN map ms ON ms.g = c.g AND ms.key = c.src LEFT JOIN map md ON md.g = c.g AND md.key = c.dst WHERE c.kind NOT IN ('END_EVENT', 'START_EVENT') OR e1.g IS NOT NULL OR s2.g IS NOT NULL)
    SELECT d.g, task_kind, pos, kind, key.process_key, subject_key, label, coalesce(a.own, src) AS src, coalesce(b.own, dst) AS dst, inputs, {_DISTINCT.format(x='refs')} AS evidence_refs
    FROM d JOIN key USING (g) LEFT JOIN moved a ON a.g = d.g AND a.key = d.src LEFT JOIN moved b ON b.g = d.g AND b.key = d.dst""")
def aligned_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches aligned in one flow."""
    out = alignment.align(fragment_facts(spark, sf_dir))
    return out.select("g", "task_kind", "pos", "kind", "process_key", "subject_key", "label", "src", "dst", "inputs", "evidence_refs")


#: A conversation as its schema has it: turns by reference, at most six, each a role and a text or a number, none twice.
CONVERSATION = {
    "type": "object", "required": ["id", "turns"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "maximum": 100_000}, "turns": {"type": "array", "maxItems": 6, "uniqueItems": True, "items": {"$ref": "#/$defs/turn"}}},
    "$defs": {
        "turn": {
            "type": "object", "required": ["role"], "additionalProperties": {"type": "boolean"},
            "properties": {"role": {"enum": ["user", "assistant", "system"]}, "body": {"oneOf": [{"type": "string", "maxLength": 200}, {"type": "number", "minimum": 0}]}},
        }
    },
}


@R.add("""
    WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, role, text, conv_id % 5 AS m FROM conversations),
    d AS (SELECT *, '/turns/' || i AS place, CASE WHEN m = 1 THEN 'n' ELSE role END AS r, length(coalesce(text, '')) > 200 AS long FROM t),
    x AS (SELECT DISTINCT conv_id, '/turns' AS pointer, 'maxItems' AS keyword FROM d WHERE n > 6
        UNION ALL SELECT conv_id, '/turns', 'uniqueItems' FROM d GROUP BY conv_id HAVING count(*) > count(DISTINCT (r, CASE WHEN m = 2 THEN (-turn)::VARCHAR ELSE coalesce(text, '') END, CASE WHEN m = 3 THEN turn END))
        UNION ALL SELECT conv_id, place || '/role', 'enum' FROM d WHERE m <> 4 AND r NOT IN ('user', 'assistant', 'system') UNION ALL SELECT conv_id, place || '/role', 'required' FROM d WHERE m = 4
        UNION ALL SELECT conv_id, place || '/body', 'oneOf' FROM d WHERE CASE WHEN m = 2 THEN turn > 0 ELSE long END UNION ALL SELECT conv_id, place || '/more', 'type' FROM d WHERE m = 3
        UNION ALL SELECT DISTINCT conv_id, '/id', 'required' FROM d WHERE m = 0 UNION ALL SELECT DISTINCT conv_id, '/key', 'additionalProperties' FROM d WHERE m = 0 UNION ALL SELECT DISTINCT conv_id, '/id', 'maximum' FROM d WHERE m > 0 AND conv_id > 100000)
    SELECT conv_id, pointer, keyword FROM x""")
def nested_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: conversations as nested documents against a schema, four of five written wrongly in one way or another."""
    m, turns = F.col("conv_id") % 5, table(spark, sf_dir, "conversations")
    body = F.when(m == 2, (-F.col("turn")).cast("string")).otherwise(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x"))))
    body = F.when(m == 2, body).otherwise(F.regexp_replace(body, r'^\{"x":|\}$', ""))
    role = F.when(m == 4, F.lit("")).otherwise(F.concat(F.lit('"role":"'), F.when(m == 1, "n").otherwise(F.col("role")), F.lit('",')))
    one = F.concat(F.lit("{"), role, F.lit('"body":'), body, F.when(m == 3, F.concat(F.lit(',"more":'), F.col("turn").cast("string"))).otherwise(""), F.lit("}"))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", one.alias("json")))), lambda t: t["json"]), ",").alias("turns"))
    key = F.when(m == 0, "key").otherwise("id")
    text = F.concat(F.lit('{"'), key, F.lit('":'), F.col("conv_id").cast("string"), F.lit(',"turns":['), F.col("turns"), F.lit("]}"))
    return docs.select("conv_id", F.explode(schemas.breaches(CONVERSATION, text)).alias("e")).select("conv_id", "e.pointer", "e.keyword")


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and orders as a hierarchy, and what they put out and take in: an order's status is told by its customer unless the balance is negative, by a nation with an even
    key, and by all regions but the first; every tenth customer takes in what its siblings put out."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    none = F.lit(None).cast("string")
    tree = r.select(text("r", "r_regionkey").alias("node"), F.lit("L3").alias("type"), none.alias("parent_id"))
    tree = tree.unionByName(n.select(text("n", "n_nationkey").alias("node"), F.lit("L4").alias("type"), text("r", "n_regionkey").alias("parent_id")))
    tree = tree.unionByName(c.select(text("c", "c_custkey").alias("node"), F.lit("L5").alias("type"), text("n", "c_nationkey").alias("parent_id")))
    tree = tree.unionByName(o.select(text("o", "o_orderkey").alias("node"), F.lit("L6").alias("type"), text("c", "o_custkey").alias("parent_id")))
    each = F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P")))
    out = [
        o.select(text("o", "o_orderkey").alias("node"), F.col("o_orderstatus").alias("name")), c.where("c_acctbal >= 0").select(text("c", "c_custkey").alias("node"), each.alias("name")),
        n.where("n_nationkey % 2 = 0").select(text("n", "n_nationkey").alias("node"), each.alias("name")), r.where("r_regionkey > 0").select(text("r", "r_regionkey").alias("node"), each.alias("name")),
    ]
    uses = [x.withColumn("kind", F.lit("OUTPUT")) for x in out] + [c.where("c_custkey % 10 = 0").select(text("c", "c_custkey").alias("node"), F.lit("O").alias("name"), F.lit("INPUT").alias("kind"))]
    whole = uses[0]
    for x in uses[1:]:
        whole = whole.unionByName(x)
    return tree, whole


@R.add("""
    WITH c AS (SELECT c_custkey AS k, c_acctbal >= 0 AS has, n_nationkey % 2 = 0 AS nat, n_nationkey AS n, n_regionkey > 0 AS reg FROM customer JOIN nation ON n_nationkey = c_nationkey),
    x AS (SELECT 'o' || o_orderkey AS node, 'L6' AS type, o_orderstatus AS output, CASE WHEN NOT has THEN 0 WHEN NOT nat THEN 1 WHEN NOT reg THEN 2 ELSE 3 END AS reached, 3 AS depth FROM orders JOIN c ON k = o_custkey
        UNION ALL SELECT 'c' || k, 'L5', s, CASE WHEN NOT nat THEN 0 WHEN NOT reg THEN 1 ELSE 2 END, 2 FROM c, (VALUES ('F'), ('O'), ('P')) v(s) WHERE has AND NOT (s = 'O' AND EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = n AND d.c_custkey % 10 = 0 AND d.c_custkey <> k))
        UNION ALL SELECT 'n' || n_nationkey, 'L4', s, CASE WHEN n_regionkey > 0 THEN 1 ELSE 0 END, 1 FROM nation, (VALUES ('F'), ('O'), ('P')) v(s) WHERE n_nationkey % 2 = 0)
    SELECT node, type, output, reached::BIGINT AS reached FROM x WHERE reached < depth""")
def output_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of all levels that are lost on the way from the leaf to the root."""
    return graph.continuity(*_hierarchy(spark, sf_dir))


def _page_reader(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a reader of pictures: it tells a page's address and its text's length, and fails at some pages in its own ways."""
    number = batch["asset"].astype(int)
    if (number % 7 == 0).any():
        raise RuntimeError("unreadable")
    size = batch["content"].fillna("").str.len()
    markdown = [None if n % 5 == 0 else f"# {place}\n" + "word " * (s // 10) for n, place, s in zip(number, batch["locator"], size)]
    regions = [[] if n % 11 == 0 else ["0,0,1,1"] for n in number]
    return pd.DataFrame({"markdown": markdown, "regions": regions, "confidence": [1.5 if n % 13 == 0 else 0.5 for n in number]})


_PAGE_TOKENS = 400


@R.add(f"""
    WITH p AS (SELECT page_id, url, length(coalesce(html, '')) AS size, '# ' || url || chr(10) || repeat('word ', length(coalesce(html, '')) // 10) AS markdown FROM pages),
    r AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'RuntimeError: unreadable' WHEN page_id % 5 = 0 THEN 'no markdown' WHEN page_id % 11 = 0 THEN 'no regions' WHEN page_id % 13 = 0 THEN 'no valid confidence'
        WHEN {tokens_sql('markdown')} / {_PAGE_TOKENS}.0::DOUBLE > 1.2 THEN 'over budget' END AS reason, sha256(page_id::VARCHAR) AS sha FROM p),
    h AS (SELECT *, CASE WHEN reason IS NULL THEN markdown ELSE concat_ws(chr(10), '---', 'chunk_id: VC-' || sha[:12], 'source_sha256: ' || sha, 'modality: VISUAL_ASSET', 'status: VISUAL_REFINEMENT_UNAVAILABLE', '---', '',
        '<!-- VISUAL_REFINEMENT_UNAVAILABLE: ' || reason || ' -->', '', '[visual asset: ' || url || ']') END AS t FROM r)
    SELECT page_id::VARCHAR AS asset, 'VC-' || sha[:12] AS chunk_id, CASE WHEN reason IS NULL THEN 'REFINED' ELSE 'VISUAL_REFINEMENT_UNAVAILABLE' END AS status, reason, sha256(t) AS markdown_sha256, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS n_regions,
        CASE WHEN reason IS NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, {tokens_sql('t')} AS tokens FROM h""")
def visual_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 and the registry of §2.14: all pages as pictures for a provider that raises, gives too little, or too much."""
    assets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset"), F.col("url").alias("locator"), F.col("html").alias("content"))
    found = providers.refined(assets, providers.Provider("page-reader", "1", _page_reader), _PAGE_TOKENS)
    return found.select("asset", "chunk_id", "status", "reason", F.sha2("markdown", 256).alias("markdown_sha256"), F.size("regions").alias("n_regions"), "confidence", "tokens")
