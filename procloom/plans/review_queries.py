"""Queries on orders, batches of mixed blocks, cards, schemas, diagrams as evidence, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators import budget, candidates, facts, findings, packing, rules, state
from procloom.plans import models as M
from procloom.plans.fixtures import Fixture
from procloom.plans.registry import Registry, table
from procloom.plans.text_queries import status_sql, tokens_sql, utf16_sql
from procloom.sources import files, markdown, sinks
from procloom.tables import place

R = Registry()


@R.add("SELECT o_custkey::VARCHAR AS run_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS place FROM orders")
def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: orders as findings of their customers."""
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("rule_id"), F.array("o_orderstatus").alias("targets"), F.col("o_orderkey").alias("pos"))
    return findings.ordered(made).select("run_id", "pos", "place")


@R.add("SELECT user_id::VARCHAR AS grp, event_id::VARCHAR AS fact_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(event_type, ''), '', coalesce(props, ''), coalesce(ts::DATE::VARCHAR, ''), event_id::VARCHAR) AS place FROM events")
def facts_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: events as facts of their users."""
    text = lambda c: F.col(c).cast("string")
    made = table(spark, sf_dir, "events").select(text("user_id").alias("grp"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("process_key"), F.col("props").alias("subject_key"), F.to_date("ts").cast("string").alias("label"), text("event_id").alias("fact_id"))
    return facts.ordered(made).select("grp", "fact_id", "place")


@R.add("""
    WITH e AS (SELECT user_id::VARCHAR AS grp, event_id::VARCHAR AS chunk_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) ELSE upper(event_type[1]) || event_type[2:] END AS name FROM events)
    SELECT grp, chunk_id, row_number() OVER (PARTITION BY grp ORDER BY lower(name), name DESC, chunk_id) AS place FROM e""")
def chunks_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: names in three ways of writing; the same letters stand together, small ones first."""
    kind = F.col("event_type")
    name = F.when(F.col("event_id") % 3 == 0, kind).when(F.col("event_id") % 3 == 1, F.upper(kind)).otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100)))
    made = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("grp"), name.alias("name"), F.lit("").alias("sha"), F.col("event_id").cast("string").alias("chunk_id"))
    return budget.ordered_chunks(made).select("grp", "chunk_id", "place")


@R.add("SELECT source AS grp, doc_id::VARCHAR AS process_key, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang <> 'de' THEN n_chars % 50 END NULLS LAST, doc_id::VARCHAR) AS place FROM documents")
def candidates_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates; German ones have no line."""
    line = F.when(F.col("lang") != "de", F.col("n_chars") % 50)
    made = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), line.alias("line_start"), F.col("doc_id").cast("string").alias("process_key"))
    return candidates.ordered(made).select("grp", "process_key", "place")


@R.add("SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(printf('%.2f', l_orderkey / 7.0 - l_linenumber), '0+$', ''), '\\.$', '') AS x FROM lineitem")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.coordinate(F.col("l_orderkey") / F.lit(7.0) - F.col("l_linenumber")).alias("x"))


def _greedy(name: str, units: str, max_blocks: int, max_chars: int) -> str:
    """CTEs that end in a table of grp, ord, batch_no for units (grp, ord, blocks, chars)."""
    return f"""{name}_u AS ({units}), {name}_n AS (SELECT *, blocks > {max_blocks} OR chars > {max_chars} AS alone, row_number() OVER g AS n, sum(blocks) OVER g AS sb, sum(chars) OVER g AS sc FROM {name}_u WINDOW g AS (PARTITION BY grp ORDER BY ord)),
        {name}_h AS (SELECT a.grp, a.n, min(b.n) AS t FROM {name}_n a JOIN {name}_n b ON b.grp = a.grp AND b.n > a.n AND b.n <= a.n + {max_blocks} WHERE a.alone OR b.alone OR b.sb - a.sb + a.blocks > {max_blocks} OR b.sc - a.sc + a.chars > {max_chars} GROUP BY 1, 2),
        {name}_s AS (SELECT grp, 1::BIGINT AS n, 0::BIGINT AS batch_no FROM {name}_n WHERE n = 1 UNION ALL SELECT h.grp, h.t, s.batch_no + 1 FROM {name}_s s JOIN {name}_h h ON h.grp = s.grp AND h.n = s.n),
        {name} AS (SELECT n.grp, n.ord, s.batch_no FROM {name}_n n ASOF JOIN {name}_s s ON s.grp = n.grp AND n.n >= s.n)"""


def mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks: short ones stand for pictures, some with bars for tables."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "content"))
    kind = F.when(F.length("content") < 12, "VISUAL_ASSET").when(F.contains("content", F.lit("|")), "TABLE").otherwise("TEXT")
    doc = F.col("doc_id").cast("string")
    return lines.select("run", doc.alias("artifact"), (F.col("doc_id") * 100_000 + F.col("k")).alias("pos"), F.concat(doc, F.lit("-"), F.col("k").cast("string")).alias("block_id"), F.sha2(doc, 256).alias("artifact_sha256"), kind.alias("modality"), "content")


_MIXED = f"""l AS (SELECT source AS run, doc_id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS content FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
    b AS (SELECT run, doc_id::VARCHAR AS artifact, doc_id * 100000 + k AS pos, doc_id || '-' || k AS block_id, content, CASE WHEN length(content) < 12 THEN 'VISUAL_ASSET' WHEN contains(content, '|') THEN 'TABLE' ELSE 'TEXT' END AS modality, {utf16_sql('content')} AS chars FROM l),
    g AS (SELECT run, artifact, min(pos) AS ord, count(*) AS blocks, sum(chars)::BIGINT AS chars FROM b WHERE modality <> 'VISUAL_ASSET' GROUP BY 1, 2)"""
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
#: Blocks over the limit in pieces of 12000 characters; lines have no line ends, so paragraphs and lines leave them whole.
_CUT = f"""x AS (SELECT b.*, g.ord AS first, g.blocks > 12 OR g.chars > 12000 AS large, b.chars > 12000 AS long FROM b JOIN g USING (run, artifact) WHERE b.modality <> 'VISUAL_ASSET'),
    y AS (SELECT * EXCLUDE (content), CASE WHEN long THEN trim(content, {_BLANK}) ELSE content END AS whole, unnest(CASE WHEN long THEN range(0, length(trim(content, {_BLANK})), 12000) ELSE [0] END) AS spot FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY spot) - 1 AS piece, CASE WHEN long THEN substr(whole, spot + 1, 12000) ELSE whole END AS content FROM y),
    c AS (SELECT * EXCLUDE (block_id, chars), {utf16_sql('content')} AS chars, CASE WHEN long THEN 'B-' || sha256(sha256(artifact) || ':' || block_id || ':' || coalesce(sum({utf16_sql('content')}) OVER (PARTITION BY pos ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)[:12] ELSE block_id END AS block_id FROM z)"""


@R.add(f"""
    WITH RECURSIVE {_MIXED}, {_CUT}, {_greedy('p', 'SELECT run AS grp, ord, blocks, chars FROM g', 12, 12000)},
    {_greedy('q', "SELECT artifact AS grp, pos * 1000 + piece AS ord, 1::BIGINT AS blocks, chars FROM c WHERE large", 12, 12000)},
    m AS (SELECT run, true AS visual, pos AS batch_no, 0::BIGINT AS sub_no, artifact, pos, block_id, content, modality, chars, 0::BIGINT AS piece FROM b WHERE modality = 'VISUAL_ASSET'
        UNION ALL SELECT c.run, false, p.batch_no, coalesce(q.batch_no, 0), c.artifact, c.pos, c.block_id, c.content, c.modality, c.chars, c.piece FROM c JOIN p ON p.grp = c.run AND p.ord = c.first LEFT JOIN q ON q.grp = c.artifact AND q.ord = c.pos * 1000 + c.piece),
    t AS (SELECT run, visual, batch_no, sub_no, 'EB-' || sha256(string_agg(block_id, ',' ORDER BY block_id))[:12] AS batch_id, sha256(string_agg(sha256(content), ',' ORDER BY sha256(content))) AS batch_sha256, count(*) AS n_blocks, sum(chars)::BIGINT AS chars,
        {tokens_sql("string_agg(content, chr(10) ORDER BY pos, piece)")} AS tokens, list(modality ORDER BY pos, piece) AS ms, list(DISTINCT artifact ORDER BY artifact) AS artifacts FROM m GROUP BY 1, 2, 3, 4)
    SELECT run, row_number() OVER (PARTITION BY run ORDER BY visual DESC, batch_no, sub_no) AS no, batch_id, batch_sha256, n_blocks, chars, tokens, {status_sql('tokens', 8000.0)} AS status,
        list_filter(ms, lambda x, i: list_position(ms, x) = i) AS modality_mix, artifacts FROM t""")
def evidence_batch_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of all lines of documents, by source."""
    return packing.batches(mixed_blocks(spark, sf_dir))


CARDS = Fixture(
    "g string, pos bigint, kind string, label string, certainty string",
    [("a", 1, "PROCESS_NAME", "Buy", "INFERRED"), ("a", 2, "PROCESS_NAME", "Purchase", None), ("a", 3, "PROCESS_LEVEL", "level", "EXPLICIT"), ("a", 4, "PROCESS_LEVEL", "L5", "INFERRED"), ("a", 5, "PROCESS_OWNER", "Head", "INFERRED"),
     ("b", 1, "PROCESS_LEVEL", "L3", "EXPLICIT"), ("b", 2, "PROCESS_LEVEL", "L4", "EXPLICIT"), ("c", 1, "PROCESS_LEVEL", "L9", "EXPLICIT"), ("c", 2, "PROCESS_PURPOSE", "Aim", "EXPLICIT"), ("c", 3, "ACTIVITY", "Do", "EXPLICIT")],
)


@R.add(f"""
    WITH f AS (SELECT *, coalesce(certainty, 'EXPLICIT') AS sure FROM {CARDS.sql}), w AS (SELECT DISTINCT g, unnest(['PROCESS_NAME', 'PROCESS_LEVEL', 'PROCESS_OWNER', 'PROCESS_PURPOSE']) AS kind FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY sure <> 'EXPLICIT', pos) AS n FROM f WHERE kind <> 'PROCESS_LEVEL' OR label IN ('L1', 'L2', 'L3', 'L4', 'L5'))
    SELECT w.g, w.kind, CASE WHEN w.kind = 'PROCESS_LEVEL' THEN coalesce(label, 'L4') ELSE label END AS value, coalesce(sure, 'MISSING') AS certainty,
        CASE WHEN w.kind = 'PROCESS_LEVEL' THEN coalesce(label IN ('L4', 'L5'), false) END AS is_leaf, coalesce(sure, 'MISSING') <> 'EXPLICIT' AS question FROM w LEFT JOIN r ON r.g = w.g AND r.kind = w.kind AND r.n = 1""")
def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16."""
    return facts.card_fields(CARDS.df(spark))


SIBLINGS = Fixture(
    "g string, pos bigint, kind string, subject_key string, label string, evidence_refs array<string>",
    [("a", 1, "ACTIVITY", "s1", "Check", ["B-1"]), ("a", 2, "INPUT", "s1", "Form", ["B-2", "B-1"]), ("a", 3, "SLA", "s1", "3天", ["B-3"]), ("a", 4, "SLA", "s1", "5小时", None), ("a", 5, "RESPONSIBILITY", "s1", "signs", ["B-4"]),
     ("a", 6, "ROLE", "s1", "Clerk", None), ("a", 7, "CONFIRMATION_CONDITION", "s1", "one、two, three", ["B-5"]), ("a", 8, "OUTPUT", "s9", "Lost", ["B-6"]), ("a", 9, "ACTIVITY", "s2", "Twice", None), ("a", 10, "ACTIVITY", "s2", "Again", ["B-7"]),
     ("a", 11, "INPUT", "s2", "Form", ["B-7"]), ("a", 12, "INPUT", "s2", "Form", ["B-8"]), ("b", 1, "INPUT", "s1", "Other", ["B-9"]), ("b", 2, "RULE", "s1", "rule", ["B-9"])],
)


@R.add(f"""
    WITH f AS (SELECT *, CASE WHEN kind = 'RESPONSIBILITY' THEN 'ROLE' WHEN kind IN ('INPUT', 'OUTPUT', 'SLA', 'CONFIRMATION_CONDITION') THEN 'ACTIVITY' END AS side FROM {SIBLINGS.sql}),
    t AS (SELECT f.*, (SELECT max(pos) FROM f x WHERE x.g = f.g AND x.subject_key = f.subject_key AND x.kind = f.side) AS target FROM f),
    s AS (SELECT g, target AS pos, list(label ORDER BY pos) FILTER (kind = 'INPUT') AS i, list(label ORDER BY pos) FILTER (kind = 'OUTPUT') AS o, list(label ORDER BY pos) FILTER (kind = 'RESPONSIBILITY') AS r, arg_max(label, pos) FILTER (kind = 'SLA') AS sla,
        flatten(list(list_filter(list_transform(regexp_split_to_array(label, '[、,，]'), lambda v: trim(v)), lambda v: v <> '') ORDER BY pos) FILTER (kind = 'CONFIRMATION_CONDITION')) AS c, flatten(list(coalesce(evidence_refs, []) ORDER BY pos)) AS refs FROM t WHERE target IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT t.*, s.*  EXCLUDE (g, pos), coalesce(t.evidence_refs, []) || coalesce(s.refs, []) AS every FROM t LEFT JOIN s ON s.g = t.g AND s.pos = t.pos WHERE target IS NULL)
    SELECT g, pos, kind, subject_key, label, CASE WHEN kind = 'ACTIVITY' THEN coalesce(i, []) END AS inputs, CASE WHEN kind = 'ACTIVITY' THEN coalesce(o, []) END AS outputs, CASE WHEN kind = 'ROLE' THEN coalesce(r, []) END AS responsibilities,
        CASE WHEN kind = 'ACTIVITY' THEN coalesce(c, []) END AS completion_criteria, CASE WHEN kind = 'ACTIVITY' THEN TRY_CAST(regexp_extract(sla, '(\\d+)', 1) AS INTEGER) END AS sla_value, list_filter(every, lambda x, k: list_position(every, x) = k) AS evidence_refs FROM u""")
def sibling_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return facts.aggregate_siblings(SIBLINGS.df(spark))


@R.add("""
    WITH c AS (SELECT conv_id || ':' || turn AS key, * FROM conversations)
    SELECT key, 'role' AS field, 'ENUM' AS problem FROM c WHERE role NOT IN ('user') UNION ALL SELECT key, 'turn', 'MAXIMUM' FROM c WHERE turn > 2
    UNION ALL SELECT key, 'text', 'MISSING' FROM c WHERE text IS NULL UNION ALL SELECT key, 'text', 'PATTERN' FROM c WHERE NOT regexp_matches(text, '^[A-Z]') UNION ALL SELECT key, 'text', 'TOO_LONG' FROM c WHERE length(text) > 300""")
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: all turns against rules for roles, turns and texts."""
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return state.schema_problems(rows, "key", [state.Field("role", values=("user",)), state.Field("turn", least=0, most=2), state.Field("text", required=True, pattern="^[A-Z]", longest=300)])


_BPMN = """'<definitions xmlns="b"><process id="P"><startEvent id="s" name="' || n_name || '"/><userTask id="t" name="' || n_name || ' &amp; more"/><sequenceFlow id="f" sourceRef="s" targetRef="t"/><exclusiveGateway id="g" name=""/></process></definitions>'"""


@R.add(f"""
    WITH f AS (SELECT n_nationkey AS n, n_name, {_BPMN} AS text FROM nation),
    x AS (SELECT 'd/' || n || '.bpmn' AS path, text, 'diagram:bpmn' AS locator, '[{{"id":"t","name":"' || n_name || ' & more","type":"task"}},{{"id":"s","name":"' || n_name || '","type":"event"}},{{"id":"g","name":"","type":"gateway"}},{{"id":"f","source":"s","target":"t","type":"flow"}}]' AS content FROM f
        UNION ALL SELECT 'd/' || n || 'x.bpmn', '<' || n_name, 'diagram:bpmn', '<' || n_name FROM f UNION ALL SELECT 'd/' || n || '.mmd', 'graph TD' || chr(10) || n_name || '-->B', 'mermaid:full', 'graph TD' || chr(10) || n_name || '-->B' FROM f
        UNION ALL SELECT 'd/' || n || '.PNG', n_name, 'image:png', '[PNG image: ' || n || '.PNG]' FROM f UNION ALL SELECT 'd/' || n || '.exe', n_name, NULL, NULL FROM f)
    SELECT path, CASE locator WHEN 'image:png' THEN 'VISUAL_ASSET' ELSE CASE WHEN locator IS NOT NULL THEN 'STRUCTURED_DIAGRAM' END END AS modality, locator, CASE WHEN locator <> 'image:png' THEN len(string_split(text, chr(10)))::INTEGER END AS line_end,
        'B-' || sha256(sha256(text) || ':' || locator)[:12] AS block_id, content, CASE WHEN locator = 'image:png' THEN sha256('[image:png]') WHEN locator IS NOT NULL THEN sha256(text) END AS content_sha256, CASE WHEN locator IS NULL THEN 'UNSUPPORTED' END AS problem FROM x""")
def diagram_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as BPMN (one of two broken), Mermaid, pictures and unknown files."""
    name = F.col("n_name")
    bpmn = F.concat(F.lit('<definitions xmlns="b"><process id="P"><startEvent id="s" name="'), name, F.lit('"/><userTask id="t" name="'), name, F.lit(' &amp; more"/><sequenceFlow id="f" sourceRef="s" targetRef="t"/><exclusiveGateway id="g" name=""/></process></definitions>'))
    made = {".bpmn": bpmn, "x.bpmn": F.concat(F.lit("<"), name), ".mmd": F.concat(F.lit("graph TD\n"), name, F.lit("-->B")), ".PNG": name, ".exe": name}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), v.alias("text")) for k, v in made.items()]))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), each.alias("f"))
    return files.diagram_blocks(rows.select(F.concat(F.lit("d/"), "n", "f.end").alias("path"), F.encode("f.text", "UTF-8").alias("content")))


@R.add("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: a table published twice in one place, and read back."""
    path = place(spark, "published")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.publish(rows.limit(1), path)
    sinks.publish(rows, path)
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey long").json(sinks.current(spark, path))


S_NODES = Fixture(
    "g string, node string, node_type string",
    [("d", "m1", "MAIN_TASK"), ("d", "m2", "MAIN_TASK"), ("d", "m3", "MAIN_TASK"), ("d", "m4", "MAIN_TASK"), ("d", "c1", "CONFIRMATION_TASK"), ("d", "c2", "CONFIRMATION_TASK"), ("d", "c3", "CONFIRMATION_TASK"), ("d", "c4", "CONFIRMATION_TASK"), ("d", "c5", "CONFIRMATION_TASK"),
     ("d", "and", "AND_GATEWAY"), ("d", "and2", "AND_GATEWAY"), ("e", "m1", "MAIN_TASK"), ("e", "c1", "CONFIRMATION_TASK")],
)
S_FLOWS = Fixture("g string, src string, dst string", [("d", "m1", "c1"), ("d", "m1", "c2"), ("d", "m2", "c3"), ("d", "m1", "c4"), ("d", "m2", "c4"), ("d", "and", "m2"), ("d", "and", "c3"), ("d", "and2", "m1"), ("d", "m4", "c2"), ("e", "m1", "c1"), ("e", "m1", "c1")])
S_BINDINGS = Fixture("g string, activity string, main_task string, confirmation_task string, pos int", [("d", "a1", "m1", "c1", 1), ("d", "a2", "m2", "c3", 2), ("d", "ghost", "m3", None, 3), ("e", "x", "m1", None, 1)])
S_ACTIVITIES = Fixture("g string, activity string, activity_type string, confirm_role string", [("d", "a1", "STANDARD", "boss"), ("d", "a2", "STANDARD", None), ("e", "x", "REVIEW_MEETING", None)])


@R.add(f"""
    WITH n AS (SELECT * FROM {S_NODES.sql}), f AS (SELECT DISTINCT * FROM {S_FLOWS.sql}), b AS (SELECT * FROM {S_BINDINGS.sql}), a AS (SELECT * FROM {S_ACTIVITIES.sql}),
    behind AS (SELECT DISTINCT b.g, b.activity, n.node AS conf FROM b JOIN f ON f.g = b.g AND f.src = b.main_task JOIN n ON n.g = f.g AND n.node = f.dst AND n.node_type = 'CONFIRMATION_TASK'),
    conf AS (SELECT * FROM behind UNION SELECT g, activity, confirmation_task FROM b WHERE confirmation_task IS NOT NULL),
    free AS (SELECT n.g, n.node, (SELECT count(DISTINCT activity) FROM behind x WHERE x.g = n.g AND x.conf = n.node) AS k, (SELECT min(activity) FROM behind x WHERE x.g = n.g AND x.conf = n.node) AS activity FROM n
        WHERE node_type = 'CONFIRMATION_TASK' AND NOT EXISTS (SELECT 1 FROM b WHERE b.g = n.g AND b.confirmation_task = n.node))
    SELECT 'FA-ACT-BPMN-002' AS rule_id, g, node AS target FROM n WHERE node_type = 'MAIN_TASK' AND NOT EXISTS (SELECT 1 FROM b JOIN a USING (g, activity) WHERE b.g = n.g AND b.main_task = n.node)
    UNION SELECT 'FA-ACT-BPMN-004', a.g, a.activity FROM a WHERE confirm_role IS NULL AND activity_type = 'STANDARD' AND (SELECT arg_min({{'c': confirmation_task}}, pos).c FROM b WHERE b.g = a.g AND b.activity = a.activity) IS NOT NULL
    UNION SELECT 'FA-ACT-BPMN-004', g, node FROM free WHERE k <> 1
    UNION SELECT 'FA-ACT-BPMN-004', free.g, free.activity FROM free JOIN a ON a.g = free.g AND a.activity = free.activity WHERE k = 1
    UNION SELECT 'FA-ACT-BPMN-009', g, activity FROM conf GROUP BY ALL HAVING count(*) > 1
    UNION SELECT 'FA-ACT-BPMN-009', b.g, b.activity FROM b JOIN conf USING (g, activity) JOIN n ON n.g = b.g AND n.node_type = 'AND_GATEWAY' WHERE EXISTS (SELECT 1 FROM f WHERE f.g = n.g AND f.src = n.node AND f.dst = b.main_task) AND EXISTS (SELECT 1 FROM f WHERE f.g = n.g AND f.src = n.node AND f.dst = conf.conf)""")
def activity_structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FA-ACT-BPMN-002, 004 and 009 as the diagram shows them."""
    return rules.structure_findings(S_ACTIVITIES.df(spark), S_BINDINGS.df(spark), S_NODES.df(spark), S_FLOWS.df(spark))


@R.add("""
    WITH e AS (SELECT user_id::VARCHAR AS g, event_id::VARCHAR AS element, CASE event_type WHEN 'click' THEN 'TASK' WHEN 'error' THEN 'EVENT' ELSE 'DATA_OBJECT' END AS type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, value FROM events),
    f AS (SELECT g, element AS src, nxt::VARCHAR AS dst FROM e WHERE value > 100 AND nxt IS NOT NULL)
    SELECT 'FA-BPMN-007' AS rule_id, g, element AS target FROM e WHERE type <> 'DATA_OBJECT' AND NOT EXISTS (SELECT 1 FROM f WHERE f.g = e.g AND (f.src = e.element OR f.dst = e.element))""")
def isolated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FA-BPMN-007 in the older model: events as elements, with a flow to the next where their value is over 100."""
    from pyspark.sql import Window

    kind = F.when(F.col("event_type") == "click", "TASK").when(F.col("event_type") == "error", "EVENT").otherwise("DATA_OBJECT")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("string")
    made = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("g"), F.col("event_id").cast("string").alias("element"), kind.alias("type"), nxt.alias("dst"), "value")
    return rules.isolated_elements(made, made.where("value > 100 and dst is not null").select("g", F.col("element").alias("src"), "dst"))


@R.add(f"SELECT g, count(*) FILTER (len(points) >= 2) AS n_flows, CASE WHEN count(*) FILTER (len(points) >= 2) < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUCCEEDED' END AS status FROM (SELECT g, points FROM {M.WAYPOINTS.sql} UNION ALL SELECT 'v3', points[1:1] FROM {M.WAYPOINTS.sql} WHERE g = 'v1' UNION ALL SELECT 'v3', points FROM {M.WAYPOINTS.sql} WHERE flow = 'f4') GROUP BY g")
def visual_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FA-VIS-001: which diagrams show enough to be judged."""
    told = M.WAYPOINTS.df(spark)
    more = told.where("g = 'v1'").select(F.lit("v3").alias("g"), F.slice("points", 1, 1).alias("points")).unionByName(told.where("flow = 'f4'").select(F.lit("v3").alias("g"), "points"))
    return rules.visual_status(told.select("g", "points").unionByName(more))


RUNS = Fixture("run_id int, process_card boolean, activities boolean, diagram_model boolean", [(1, True, True, True), (2, True, None, False), (3, False, True, True)])


@R.add(f"""
    WITH r AS (SELECT run_id, list_filter([CASE WHEN NOT coalesce(process_card, false) THEN 'process_card' END, CASE WHEN NOT coalesce(activities, false) THEN 'activities' END, CASE WHEN NOT coalesce(diagram_model, false) THEN 'diagram_model' END], lambda x: x IS NOT NULL) AS missing FROM {RUNS.sql})
    SELECT run_id, CASE WHEN len(missing) > 0 THEN 'NEEDS_INPUT' ELSE 'SUCCEEDED' END AS status, missing FROM r""")
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review stage lacks."""
    return rules.stage_status(RUNS.df(spark))


FRAGMENTS = Fixture(
    "task_id string, raw string",
    [("ok", '{"batch_id":"b1","batch_sha256":"s1","task_kind":"K","facts":[{"evidence_refs":["B-1"]},{"evidence_refs":[]}]}'), ("text", "not json"), ("list", "[1]"), ("bare", '{"batch_id":"b1"}'), ("lost", '{"batch_id":"b9","batch_sha256":"s1","task_kind":"K"}'),
     ("hash", '{"batch_id":"b1","batch_sha256":"s0","task_kind":"K"}'), ("refs", '{"batch_id":"b1","batch_sha256":"s1","task_kind":"K","facts":[{"evidence_refs":["B-1","B-9"]}]}'), ("none", '{"batch_id":"b2","batch_sha256":"s2","task_kind":"K","facts":[]}')],
)
FRAGMENT_BATCHES = Fixture("batch_id string, batch_sha256 string, block_ids array<string>", [("b1", "s1", ["B-1", "B-2"]), ("b2", "s2", [])])


@R.add(f"""
    WITH f AS (SELECT task_id, length(raw) > 100000 AS large, coalesce(json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT', false) AS good, CASE WHEN json_valid(raw) THEN raw END AS j FROM (SELECT * FROM {FRAGMENTS.sql} UNION ALL SELECT 'long', repeat('x', 100001))),
    t AS (SELECT f.*, j ->> '$.batch_id' AS batch_id, j ->> '$.batch_sha256' AS sha, j ->> '$.task_kind' AS kind, (j ->> '$.facts[*].evidence_refs[*]') AS refs FROM f)
    SELECT task_id, CASE WHEN large THEN 'TOO_LARGE' WHEN NOT good THEN 'NOT_JSON' WHEN t.batch_id IS NULL OR sha IS NULL OR kind IS NULL THEN 'NO_ENVELOPE' WHEN b.batch_id IS NULL THEN 'UNKNOWN_BATCH' WHEN b.batch_sha256 <> sha THEN 'HASH_MISMATCH'
        WHEN len(list_filter(refs, lambda r: NOT list_contains(b.block_ids, r))) > 0 THEN 'UNKNOWN_EVIDENCE' END AS error FROM t LEFT JOIN {FRAGMENT_BATCHES.sql} b ON b.batch_id = t.batch_id""")
def fragment_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2's envelope and V5."""
    large = spark.range(1).select(F.lit("long").alias("task_id"), F.repeat(F.lit("x"), 100_001).alias("raw"))
    return state.accept_fragments(FRAGMENTS.df(spark).unionByName(large), FRAGMENT_BATCHES.df(spark))


@R.add("""
    WITH w AS (SELECT event_id::VARCHAR AS task_id, user_id AS k, event_type AS v, props AS p FROM events), e AS (SELECT user_id AS k, arg_min(event_type, event_id) AS v, arg_min(props, event_id) AS p FROM events WHERE user_id % 3 > 0 GROUP BY 1)
    SELECT task_id, CASE WHEN e.k IS NULL THEN 'MISSING' WHEN w.v IS DISTINCT FROM e.v THEN 'VERSION' WHEN w.p IS DISTINCT FROM e.p THEN 'PARAMS' END AS reason FROM w LEFT JOIN e ON e.k = w.k""")
def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: all events as tasks, against the first event of two in three users as the cache's entry."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("cache_key"), F.col("event_type").alias("versions"), F.col("props").alias("params"))
    entries = rows.where("cast(cache_key as long) % 3 > 0").groupBy("cache_key").agg(F.min_by(F.struct("versions", "params"), "event_id").alias("e")).select("cache_key", "e.*")
    return state.reusable(rows.withColumn("task_id", F.col("event_id").cast("string")), entries)


@R.add("SELECT o_orderkey, upper(CASE o_orderkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'cm-' || (o_orderkey / 10)::VARCHAR ELSE trim(o_orderpriority) END) AS canonical FROM orders")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank keys, keys with points, and keys with blanks around them."""
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.lit("  ")).when(key % 3 == 1, F.concat(F.lit(" cm-"), (key / 10).cast("string"))).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.canonical_key(raw).alias("canonical"))


@R.add("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'VISUAL_ONLY' ELSE 'SEMI_STRUCTURED' END AS parse_mode, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.3 ELSE 0.85 END::DOUBLE AS confidence FROM documents")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as word-processor files."""
    return table(spark, sf_dir, "documents").select("doc_id", files.document_kind(F.col("text")).alias("k")).select("doc_id", "k.*")


EVENT_FACTS = Fixture(
    "g string, frag_idx int, pos int, kind string, fact_id string, label string, evidence_refs array<string>",
    [("p", 1, 1, "START_EVENT", "f1", "Ask（开始）", ["B-1"]), ("p", 2, 1, "START_EVENT", "f2", "Ask", ["B-2"]), ("p", 1, 2, "END_EVENT", "f3", "Done", ["B-1"]), ("p", 2, 2, "END_EVENT", "f4", "Done(结束)", ["B-3"]), ("p", 2, 3, "END_EVENT", "f5", "Lost（结束）", []),
     ("q", 1, 1, "START_EVENT", "f1", "Go", ["B-4"]), ("p", 3, 1, "ACTIVITY", "f6", "Ask", ["B-5"])],
)
EVENT_FLOWS = Fixture("g string, flow string, src string, dst string", [("p", "e1", "f2", "f6"), ("p", "e2", "f6", "f4"), ("p", "e3", "f1", "f5"), ("q", "e1", "f1", "f2")])


@R.add(f"""
    WITH f AS (SELECT *, trim(regexp_replace(label, CASE kind WHEN 'START_EVENT' THEN '（开始）$|\\(开始\\)$' ELSE '（结束）$|\\(结束\\)$' END, '')) AS k FROM {EVENT_FACTS.sql} WHERE kind IN ('START_EVENT', 'END_EVENT')),
    m AS (SELECT g, fact_id, first_value(fact_id) OVER (PARTITION BY g, kind, k ORDER BY frag_idx, pos) AS own FROM f)
    SELECT e.g, e.flow, coalesce(a.own, e.src) AS src, coalesce(b.own, e.dst) AS dst, coalesce(a.own <> e.src, false) OR coalesce(b.own <> e.dst, false) AS rewritten
    FROM {EVENT_FLOWS.sql} e LEFT JOIN m a ON a.g = e.g AND a.fact_id = e.src LEFT JOIN m b ON b.g = e.g AND b.fact_id = e.dst""")
def event_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between merged start and end events."""
    return facts.aligned_endpoints(EVENT_FACTS.df(spark), EVENT_FLOWS.df(spark))


@R.add(f"""
    WITH f AS (SELECT *, trim(regexp_replace(label, '（开始）$|\\(开始\\)$', '')) AS k FROM {EVENT_FACTS.sql} WHERE kind = 'START_EVENT')
    SELECT g AS process, k AS label_key, arg_min(label, frag_idx * 1000 + pos) AS label, arg_min(fact_id, frag_idx * 1000 + pos) AS fact_id, list_sort(list_distinct(flatten(list(evidence_refs)))) AS evidence_refs FROM f GROUP BY 1, 2""")
def start_event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 for start events."""
    return facts.align_events(EVENT_FACTS.df(spark).withColumns({"process_key": F.col("g"), "certainty": F.lit("EXPLICIT")}), "START_EVENT", "开始")


CODE_CELLS = Fixture(
    "doc string, table_no bigint, row_no int, col_no int, header string, cell string",
    [(d, t, r, c, rows[0][c], cell) for d, tables in {
        "x": [[["Code", "Note"], ["CM-1.1", "n"]], [["Code", "Name", "Level"], ["CM-1.1 and CM-1.2", "", "level l4"], ["CM-1.1", "Buy", ""], ["cm-2", "Lost", "Top"]], [["编号", "层级", "名称"], ["CM-1.2", "L5", "Pay"], ["CM-1.1", "L6", "Later"]]],
        "y": [[["Code", "Level"], ["CM-2", "L3"]]],
    }.items() for t, rows in enumerate(tables, 1) for r, row in enumerate(rows) for c, cell in enumerate(row)],
)
CODES = Fixture("doc string, code string", [("x", "CM-1.1"), ("x", "CM-1.2"), ("x", "cm-2 "), ("x", "CM-9"), ("y", "CM-2"), ("y", "CM-1.1")])


@R.add(f"""
    WITH c AS (SELECT * FROM {CODE_CELLS.sql}), w AS (SELECT DISTINCT doc, upper(trim(code)) AS code FROM {CODES.sql}),
    k AS (SELECT doc, table_no, row_no, upper(trim(cell)) AS own, regexp_extract_all(cell, '\\b([A-Z]{{1,4}}-\\d+(?:\\.\\d+)?)\\b', 1) AS codes FROM c WHERE col_no = 0 AND row_no > 0),
    h AS (SELECT doc, table_no, min(col_no) FILTER (regexp_matches(cell, '(?i)层级|level')) AS l, min(col_no) FILTER (regexp_matches(cell, '(?i)名称|name')) AS n FROM c WHERE row_no = 0 GROUP BY 1, 2),
    v AS (SELECT w.doc, w.code, (SELECT arg_min(trim(c.cell), c.table_no * 1000 + c.row_no) FROM c JOIN h USING (doc, table_no) JOIN k USING (doc, table_no, row_no) WHERE c.doc = w.doc AND c.col_no = h.l AND trim(c.cell) <> '' AND (k.own = w.code OR list_contains(k.codes, w.code))) AS level,
        (SELECT arg_min(trim(c.cell), c.table_no * 1000 + c.row_no) FROM c JOIN h USING (doc, table_no) JOIN k USING (doc, table_no, row_no) WHERE c.doc = w.doc AND c.col_no = h.n AND trim(c.cell) <> '' AND list_contains(k.codes, w.code)) AS name FROM w)
    SELECT doc, code, CASE WHEN regexp_matches(level, '(?i)L[0-9]+') THEN upper(regexp_extract(level, '(?i)(L[0-9]+)', 1)) ELSE level END AS level, name FROM v""")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and names of codes by the tables of their document."""
    return markdown.lookup(CODE_CELLS.df(spark), CODES.df(spark))


@R.add("""
    SELECT 'PAGE' AS locator_type, url || ':page-' || (page_id % 9 + 1) AS locator, left(coalesce(html, ''), 200) AS excerpt FROM pages
    UNION ALL SELECT 'BPMN_ELEMENT', 'm.bpmn#' || event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_id::VARCHAR END FROM events""")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and elements."""
    pages = table(spark, sf_dir, "pages").select(markdown.page_locator(F.col("url"), F.col("page_id") % 9 + 1, F.col("html")).alias("l"))
    event = F.col("event_id").cast("string")
    elements = table(spark, sf_dir, "events").select(markdown.element_locator(F.lit("m.bpmn"), event, F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")).alias("l"))
    return pages.unionByName(elements).select("l.*")
