"""Queries on extracted facts: merging, deduplication, lanes, flows, and checks of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators import facts as O
from procloom.operators import findings, names, render, state
from procloom.plans import derived as D
from procloom.plans import models as M
from procloom.plans.registry import Registry, table

R = Registry()
_KEY = "replace(coalesce(nullif(trim(process_key), ''), 'default'), '.', '-')"
_FACTS = f"facts AS (SELECT *, {_KEY} AS process FROM {D.FACTS_SQL}), sure AS (SELECT * FROM facts WHERE certainty <> 'CONFLICT')"


@R.add(f"WITH {_FACTS} SELECT process, min(trim(process_key)) AS display_code, count(*) AS n_facts, count(*) FILTER (certainty = 'CONFLICT') AS n_conflicts FROM facts GROUP BY process")
def process_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, C1, F3, F4."""
    return O.process_groups(D.facts(spark, sf_dir))


_SINGLE = "(kind IN ('ACTIVITY', 'PROCESS_NAME', 'PROCESS_LEVEL') AND subject_key IS NOT NULL)"
_DEDUP = f"""dedup_g AS (
    SELECT kind, process, subject_key, {_SINGLE} AS single, CASE WHEN {_SINGLE} THEN NULL ELSE label END AS label_key, count(*) AS n_merged,
        list_sort(list_distinct(flatten(list(evidence_refs)))) AS evidence_refs,
        list({{'batch_id': batch_id, 'fact_id': fact_id, 'label': label, 'clean': trim(coalesce(label, ''))}} ORDER BY batch_id, fact_id) AS many,
        list_filter(list_distinct(list(trim(coalesce(label, '')))), lambda t: t <> '') AS labels
    FROM facts GROUP BY 1, 2, 3, 4, 5),
dedup_h AS (
    SELECT *, list_transform(list_sort(list_transform(labels, lambda t: {{'n': length(t), 't': t}})), lambda x: x.t) AS by_length FROM dedup_g),
dedup_i AS (
    SELECT *, len(by_length) < 2 OR len(list_filter(range(1, len(by_length)), lambda i: NOT starts_with(by_length[i + 1], by_length[i]))) = 0 AS chain FROM dedup_h),
dedup_j AS (SELECT *, CASE WHEN len(labels) = 0 THEN '' WHEN chain THEN by_length[-1] ELSE list_min(labels) END AS best, len(labels) > 0 AND NOT chain AS clash, single AND n_merged > 1 AS merged FROM dedup_i),
dedup_k AS (SELECT *, CASE WHEN merged AND len(list_filter(many, lambda m: m.clean = best)) > 0 THEN list_filter(many, lambda m: m.clean = best)[1] ELSE many[1] END AS rep FROM dedup_j),
dedup AS (SELECT kind, process, subject_key, CASE WHEN merged THEN best ELSE rep.label END AS label, rep.fact_id AS fact_id, rep.batch_id AS batch_id, evidence_refs, n_merged, merged AND clash AS conflict FROM dedup_k)"""


@R.add(f"WITH {_FACTS}, {_DEDUP} SELECT * FROM dedup")
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 to A3."""
    return O.dedup_facts(D.facts(spark, sf_dir))


@R.add(f"""
    WITH f AS (SELECT source AS process_key, sha256(coalesce(text, '')) AS label, doc_id FROM documents)
    SELECT replace(process_key, '.', '-') AS process, label, count(*) AS n_merged, min(lpad(doc_id::VARCHAR, 12, '0')) AS fact_id FROM f GROUP BY 1, 2""")
def fact_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over all documents: each text is a fact of its source. A text may have any number of copies, so what they refer to comes as rows, in fact_evidence_documents."""
    return O.dedup_facts(document_facts(spark, sf_dir), refs=False).select("process", "label", "n_merged", "fact_id")


@R.add("SELECT DISTINCT replace(source, '.', '-') AS process, sha256(coalesce(text, '')) AS label, doc_id::VARCHAR AS ref FROM documents")
def fact_evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the evidence of the merged facts of all documents."""
    return O.fact_evidence(document_facts(spark, sf_dir)).select("process", F.col("label_key").alias("label"), "ref")


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.lit("REFERENCE").alias("kind"), F.col("source").alias("process_key"), F.lit(None).cast("string").alias("subject_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("label"),
        F.lit("b").alias("batch_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("fact_id"), F.array(F.col("doc_id").cast("string")).alias("evidence_refs"),
    )


def _sla_sql(c: str) -> tuple[str, str]:
    value = " ".join(f"WHEN regexp_matches({c}, '\\d+\\s*个?\\s*{w}') THEN regexp_extract({c}, '(\\d+)\\s*个?\\s*{w}', 1)::INT" for w in C.SLA_UNITS)
    unit = " ".join(f"WHEN regexp_matches({c}, '\\d+\\s*个?\\s*{w}') THEN '{u}'" for w, u in C.SLA_UNITS.items())
    return f"CASE {value} END", f"CASE {unit} END"


_AT = "frag_idx * 1000 + pos"


def _listed(kind: str, name: str) -> str:
    return f"coalesce((SELECT list(label ORDER BY k) FROM (SELECT label, min({_AT}) AS k FROM sure s WHERE s.kind = '{kind}' AND s.process = a.process AND s.subject_key = a.subject_key GROUP BY label)), []) AS {name}"


@R.add(f"""
    WITH {_FACTS}, a AS (SELECT process, subject_key, arg_max(label, {_AT}) AS name, arg_max({{'r': role}}, {_AT}).r AS role FROM sure WHERE kind = 'ACTIVITY' AND subject_key IS NOT NULL GROUP BY 1, 2),
    crit AS (SELECT process, subject_key, {_AT} AS k, i, part FROM (
        SELECT process, subject_key, frag_idx, pos, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
            SELECT *, CASE WHEN kind = 'COMPLETION_CRITERIA' THEN [label] ELSE list_filter(list_transform(regexp_split_to_array(label, '[、,，]'), lambda t: trim(t)), lambda t: t <> '') END AS parts
            FROM sure WHERE kind IN ('COMPLETION_CRITERIA', 'CONFIRMATION_CONDITION')))),
    sla AS (SELECT process, subject_key, {_AT} AS k, {_sla_sql('label')[0]} AS v, {_sla_sql('label')[1]} AS u FROM sure WHERE kind = 'SLA')
    SELECT a.process, a.subject_key, a.name, coalesce((SELECT arg_max(label, {_AT}) FROM sure s WHERE s.kind = 'ROLE' AND s.process = a.process AND s.subject_key = a.subject_key), a.role) AS role,
        {_listed('INPUT', 'inputs')}, {_listed('OUTPUT', 'outputs')}, {_listed('TOOL', 'tools')}, {_listed('REFERENCE', '"references"')},
        coalesce((SELECT list(part ORDER BY o) FROM (SELECT part, min(k * 100 + i) AS o FROM crit c WHERE c.process = a.process AND c.subject_key = a.subject_key GROUP BY part)), []) AS completion_criteria,
        (SELECT arg_min(v, k) FROM sla WHERE v IS NOT NULL AND sla.process = a.process AND sla.subject_key = a.subject_key) AS sla_value,
        (SELECT arg_min(u, k) FROM sla WHERE v IS NOT NULL AND sla.process = a.process AND sla.subject_key = a.subject_key) AS sla_unit
    FROM a""")
def activity_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, A4, C4."""
    return O.activity_aggregates(D.facts(spark, sf_dir))


@R.add(f"WITH {_FACTS} SELECT process, kind, label, count(*) AS n FROM sure f WHERE kind IN ('INPUT', 'OUTPUT') AND NOT EXISTS (SELECT 1 FROM sure a WHERE a.kind = 'ACTIVITY' AND a.process = f.process AND a.subject_key = f.subject_key) GROUP BY 1, 2, 3")
def process_level_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return O.process_io(D.facts(spark, sf_dir))


_LANES = f"""lane_k AS (SELECT process, regexp_replace(coalesce(label, ''), '\\s+', '', 'g') AS norm, label, {_AT} AS k FROM sure WHERE kind = 'ROLE'),
    lanes AS (SELECT process, norm, 'Lane-' || sha256(arg_min(label, k))[:8] AS lane_id, arg_min(label, k) AS name, min(k) AS k FROM lane_k GROUP BY 1, 2)"""
_ACTS = f"""sure_f AS (SELECT * FROM sure), acts AS (
        SELECT d.process, d.subject_key, d.fact_id FROM dedup d WHERE kind = 'ACTIVITY'),
    roles AS (SELECT process, subject_key, arg_max({{'r': role}}, {_AT}).r AS own FROM sure WHERE kind = 'ACTIVITY' GROUP BY 1, 2),
    told AS (SELECT a.*, coalesce((SELECT arg_max(label, {_AT}) FROM sure s WHERE s.kind = 'ROLE' AND s.process = a.process AND s.subject_key = a.subject_key), r.own) AS role FROM acts a LEFT JOIN roles r USING (process, subject_key))"""
_DEDUP_SURE = _DEDUP.replace("FROM facts GROUP BY", "FROM sure GROUP BY")


@R.add(f"""
    WITH {_FACTS}, {_DEDUP_SURE}, {_LANES}, {_ACTS}, j AS (
        SELECT t.*, l.lane_id, (SELECT arg_min(lane_id, k) FROM lanes x WHERE x.process = t.process) AS first_lane
        FROM told t LEFT JOIN lanes l ON l.process = t.process AND l.norm = regexp_replace(coalesce(t.role, ''), '\\s+', '', 'g'))
    SELECT process, 'Task-' || sha256(fact_id)[:8] AS task_id, role, coalesce(lane_id, first_lane, 'Lane-unassigned') AS lane_id,
        CASE WHEN lane_id IS NOT NULL THEN NULL WHEN first_lane IS NOT NULL THEN 'Q-role-' || sha256(fact_id)[:8] ELSE 'Q-nolane-' || sha256(fact_id)[:8] END AS question_id FROM j""")
def role_lane_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, A7."""
    return O.role_lanes(D.facts(spark, sf_dir))


@R.add(f"""
    WITH {_FACTS}, {_DEDUP_SURE}, n AS (SELECT process, subject_key, CASE kind WHEN 'ACTIVITY' THEN 'Task-' WHEN 'GATEWAY' THEN 'Gateway-' ELSE 'End-' END || sha256(fact_id)[:8] AS node_id FROM dedup WHERE kind IN ('ACTIVITY', 'GATEWAY', 'END_EVENT') AND subject_key IS NOT NULL),
    fl AS (SELECT f.process, s.node_id AS source_ref, t.node_id AS target_ref, f.fact_id, f.source_key, f.target_key, row_number() OVER (PARTITION BY f.process, s.node_id, t.node_id ORDER BY f.frag_idx, f.pos) AS rn
        FROM sure f JOIN n s ON s.process = f.process AND s.subject_key = f.source_key JOIN n t ON t.process = f.process AND t.subject_key = f.target_key WHERE f.kind = 'FLOW')
    SELECT process, 'Flow-' || sha256(fact_id)[:8] AS flow_id, source_ref, target_ref,
        (SELECT arg_min(label, {_AT}) FROM sure c WHERE c.kind = 'CONDITION' AND c.process = fl.process AND c.source_key = fl.source_key AND (c.target_key IS NULL OR c.target_key = fl.target_key)) AS condition
    FROM fl WHERE rn = 1""")
def flow_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, J6, W3."""
    return O.resolve_flows(D.facts(spark, sf_dir))


@R.add("""
    WITH s AS (SELECT user_id::VARCHAR AS process, event_id::VARCHAR AS source_ref, coalesce(lead(event_id) OVER w::VARCHAR, 'End') AS target_ref FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT user_id::VARCHAR AS process, 'Start' AS source_ref, arg_min(event_id, {'a': ts, 'b': event_id})::VARCHAR AS target_ref FROM events GROUP BY user_id)
    SELECT * FROM s UNION ALL SELECT * FROM b""")
def linear_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as a process without flows."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("process"), F.struct("ts", "event_id").alias("pos"), F.col("event_id").cast("string").alias("node_id"))
    return O.linear_flows(events)


@R.add("SELECT n_name AS name FROM nation")
def terminal_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are leaves below regions."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    orgs = region.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    below = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return O.terminal_orgs(orgs.unionByName(below))


@R.add(f"""
    WITH {_FACTS}, k AS (SELECT *, trim(regexp_replace(label, '（结束）$|\\(结束\\)$', '')) AS label_key FROM sure WHERE kind = 'END_EVENT')
    SELECT process, label_key, arg_min(label, {_AT}) AS label, arg_min(fact_id, {_AT}) AS fact_id, list_sort(list_distinct(flatten(list(evidence_refs)))) AS evidence_refs FROM k GROUP BY 1, 2""")
def end_event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, V11."""
    return O.align_events(D.facts(spark, sf_dir), "END_EVENT", "结束")


_UNC = f"""u AS (SELECT * FROM {M.UNCERTAINTIES.sql}), rel AS (SELECT u.frag_idx, u.pos, bool_or(f.process = 'CM-2') AS own FROM (SELECT frag_idx, pos, unnest(related_fact_ids) AS fact_id FROM u) u JOIN facts f USING (frag_idx, fact_id) GROUP BY u.frag_idx, u.pos),
    codes AS (SELECT frag_idx, pos, list_distinct(regexp_extract_all(text, '\\b[A-Z]{{2,4}}-\\d+(?:[.-]\\d+)?')) AS codes FROM u)"""


@R.add(f"""
    WITH facts AS (SELECT frag_idx, fact_id, {_KEY} AS process FROM {D.FACTS_SQL}), {_UNC}
    SELECT u.frag_idx, u.pos, u.kind, u.text, CASE WHEN len(related_fact_ids) = 0 THEN len(codes) = 0 OR list_contains(list_transform(codes, lambda c: replace(c, '.', '-')), 'CM-2') ELSE coalesce(own, true) END AS relevant
    FROM u LEFT JOIN rel ON rel.frag_idx = u.frag_idx AND rel.pos = u.pos JOIN codes ON codes.frag_idx = u.frag_idx AND codes.pos = u.pos""")
def focus_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return O.focus_uncertainties(M.UNCERTAINTIES.df(spark), D.facts(spark, sf_dir), "CM-2")


@R.add(f"""
    WITH t AS (SELECT * FROM {M.TOPICS.sql}), c AS (
        SELECT a.group_id, a.item_id, list_distinct(flatten(list(b.topics))) AS covered FROM t a JOIN t b ON b.group_id = a.group_id AND b.item_id <> a.item_id
        WHERE len(b.topics) < len(a.topics) AND list_has_all(a.topics, b.topics) GROUP BY 1, 2)
    SELECT t.group_id, t.item_id, coalesce(list_has_all(c.covered, t.topics), false) AS dropped FROM t LEFT JOIN c ON c.group_id = t.group_id AND c.item_id = t.item_id""")
def coverage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3."""
    return O.coverage_drops(M.TOPICS.df(spark))


@R.add()
def topic_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RE2 can't look back over shared characters; the tests hold the topics against a walk over the text."""
    return M.TOPIC_TEXTS.df(spark).select("id", C.topics(F.col("text")).alias("topics"))


@R.add(f"WITH f AS (SELECT frag_idx AS frag, batch_id, fact_id, unnest(evidence_refs) AS ref FROM {D.FACTS_SQL}) SELECT frag, fact_id, ref FROM f WHERE ref NOT IN (SELECT 'B-' || frag_idx || pos FROM {D.FACTS_SQL} x WHERE x.batch_id = f.batch_id AND pos % 3 <> 0)")
def evidence_ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch has only some of the blocks."""
    facts = D.facts(spark, sf_dir)
    blocks = facts.where("pos % 3 <> 0").select("batch_id", F.concat(F.lit("B-"), F.col("frag_idx").cast("string"), F.col("pos").cast("string")).alias("block_id"))
    return state.missing_evidence(facts.withColumnRenamed("frag_idx", "frag"), blocks)


@R.add("SELECT sha256(coalesce(text, '')) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def uniqueness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur twice."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@R.add("SELECT source, count(*) AS n_blocks, list_sort(list_distinct(list(lang))) AS formats FROM documents GROUP BY source")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_set("lang")).alias("formats"))


@R.add("SELECT sha256(coalesce(text, '')) AS sha, max(lpad(doc_id::VARCHAR, 8, '0') || '.md') AS path FROM documents GROUP BY 1")
def chunk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of chunks with one hash the later path counts."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.max_by(F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md")), "doc_id").alias("path"))


_MAPPED = "'PROCESS_NAME','PROCESS_LEVEL','ACTIVITY','ROLE','INPUT','OUTPUT','TOOL','REFERENCE','SLA','FLOW','CONDITION','GATEWAY','START_EVENT','END_EVENT','CONFIRMATION_CONDITION','COMPLETION_CRITERIA','ORG_UNIT'"


@R.add(f"SELECT kind, count(*) AS n_facts, count(*) FILTER (certainty = 'CONFLICT') AS n_conflicts, kind IN ({_MAPPED}) AS mapped FROM {D.FACTS_SQL} GROUP BY kind")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6."""
    return render.merge_report(D.facts(spark, sf_dir))


_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@R.add(f"SELECT p_partkey, {_NORM.format(c='p_name')} AS norm, regexp_matches(p_name, '(?i)(_|\\b(SAP|API|SQL|DB|HTTP|JSON|XML)\\b)') AS technical FROM part")
def normal_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7, C9 over all part names."""
    return table(spark, sf_dir, "part").select("p_partkey", C.normal_name(names.compose("p_name")).alias("norm"), C.looks_technical(F.col("p_name")).alias("technical"))


_CONDITION_TEXT = "CASE operator WHEN 'EQUALS' THEN source || ' == \"' || value || '\"' WHEN 'NOT_EQUALS' THEN source || ' != \"' || value || '\"' WHEN 'GREATER_THAN' THEN source || ' > \"' || value || '\"' WHEN 'LESS_THAN' THEN source || ' < \"' || value || '\"' WHEN 'GREATER_THAN_OR_EQUAL' THEN source || ' >= \"' || value || '\"' WHEN 'LESS_THAN_OR_EQUAL' THEN source || ' <= \"' || value || '\"' WHEN 'IS_TRUE' THEN source || ' == true' WHEN 'IS_FALSE' THEN source || ' == false' ELSE source || ' contains \"' || value || '\"' END"


@R.add(f"SELECT id, replace(replace(replace(replace(replace({_CONDITION_TEXT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS text, source AS source_output, operator, value FROM {M.CONDITIONS.sql}")
def condition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written is read back."""
    text = C.xml_escape(render.condition_text(F.col("source"), F.col("operator"), F.col("value")))
    return M.CONDITIONS.df(spark).select("id", text.alias("text")).select("id", "text", render.parse_condition(F.col("text")).alias("c")).select("id", "text", "c.*")


_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in render.CATEGORIES.items()) + " ELSE '其他' END"
_ORDER = "list_position([" + ", ".join(f"'{c}'" for c in [*render.CATEGORIES, render.OTHER]) + "], category)"


@R.add(f"SELECT package_id, revision, {_CATEGORY} AS category, count(*) AS n FROM {M.QUESTIONS.sql} GROUP BY 1, 2, 3")
def question_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21."""
    return M.QUESTIONS.df(spark).groupBy("package_id", "revision", render.question_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@R.add(f"""
    WITH q AS (SELECT *, {_CATEGORY} AS category FROM {M.QUESTIONS.sql} WHERE status = 'OPEN' AND revision = 2),
    c AS (SELECT package_id, category, {_ORDER} AS k, '## ' || category || chr(10) || string_agg('- [' || question_id || '] ' || text, chr(10) ORDER BY question_id) AS t FROM q GROUP BY 1, 2, 3)
    SELECT package_id, string_agg(t, chr(10) || chr(10) ORDER BY k) AS markdown FROM c GROUP BY 1""")
def question_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5."""
    return render.agenda(M.QUESTIONS.df(spark).where("revision = 2"))


@R.add(f"""
    WITH q AS (SELECT * FROM {M.QUESTIONS.sql}), o AS (SELECT * FROM q WHERE revision = 1), n AS (SELECT * FROM q WHERE revision = 2)
    SELECT coalesce(o.package_id, n.package_id) AS package_id, coalesce(o.question_id, n.question_id) AS question_id, CASE WHEN o.question_id IS NULL THEN 'ADDED' WHEN n.question_id IS NULL THEN 'REMOVED' WHEN o.text IS DISTINCT FROM n.text OR o.status IS DISTINCT FROM n.status OR o.answer IS DISTINCT FROM n.answer THEN 'CHANGED' ELSE 'SAME' END AS change
    FROM o FULL JOIN n ON o.package_id = n.package_id AND o.question_id = n.question_id""")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, SO4."""
    q = M.QUESTIONS.df(spark)
    return render.revision_diff(q.where("revision = 1"), q.where("revision = 2"))


@R.add("SELECT event_id, sha256(props) AS sha, replace(props, ' ', '') AS canonical FROM events")
def package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's JSON in a page and out again, in canonical form."""
    events = table(spark, sf_dir, "events").select("event_id", "props", render.package_payload(render.package_html(F.col("props"))).alias("back"))
    return events.select("event_id", F.sha2("back", 256).alias("sha"), render.canonical_json(F.col("back")).alias("canonical"))


@R.add(f"""
    WITH f AS (SELECT * FROM {M.FINDINGS.sql} WHERE status IN ('SUCCEEDED', 'SUCCEEDED_WITH_WARNINGS')),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id, CASE WHEN coalesce(fingerprint, '') = '' THEN 'p' || pos ELSE fingerprint END ORDER BY n_evidence DESC, pos) AS rn FROM f)
    SELECT run_id, pos, rule_id, n_evidence FROM r WHERE rn = 1""")
def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, F6."""
    return findings.collect(M.FINDINGS.df(spark)).select("run_id", "pos", "rule_id", "n_evidence")


_POLICY = f"""policy AS (SELECT run_id, pos, rule_id, severity, fingerprint, n_evidence, status, CASE WHEN parse_mode = 'VISUAL_ONLY' AND confidence > 0.6 THEN 0.6 ELSE confidence END::DOUBLE AS confidence,
    CASE WHEN parse_mode = 'VISUAL_ONLY' AND locator_type = 'BPMN_ELEMENT' THEN 'IMAGE_REGION' ELSE locator_type END AS locator_type,
    (coalesce(parse_mode = 'VISUAL_ONLY' AND confidence > 0.6, false))::INT + (parse_mode = 'VISUAL_ONLY' AND locator_type = 'BPMN_ELEMENT')::INT AS changed FROM {M.FINDINGS.sql}),
    confirmed AS (SELECT *, coalesce(confidence < 0.8, false) AS confirm FROM policy)"""


@R.add(f"WITH {_POLICY} SELECT run_id, pos, confidence, locator_type, changed, confirm FROM confirmed")
def visual_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    return findings.visual_policy(M.FINDINGS.df(spark)).select("run_id", "pos", "confidence", "locator_type", F.coalesce("changed", F.lit(0)).alias("changed"), "confirm")


_REQUIRED = ", ".join(f"('{r}', '{s}')" for r, ss in findings.REQUIRED_STAGES.items() for s in ss)
_ISSUES = f"""st AS (SELECT * FROM {M.STAGES.sql}), good AS (SELECT * FROM st WHERE status IN ('SUCCEEDED', 'SUCCEEDED_WITH_WARNINGS')), req(route, stage_id) AS (VALUES {_REQUIRED}),
    issues AS (
        SELECT r.run_id, 'MISSING' AS issue, q.stage_id FROM (SELECT DISTINCT run_id, route FROM st) r JOIN req q USING (route) WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.run_id = r.run_id AND g.stage_id = q.stage_id)
        UNION ALL SELECT run_id, 'DEGRADED', stage_id FROM st WHERE degradation <> '' UNION ALL SELECT run_id, 'NO_EVIDENCE', stage_id FROM good WHERE n_evidence = 0)"""


@R.add(f"WITH {_ISSUES} SELECT * FROM issues")
def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, SO2."""
    return findings.gate_issues(M.STAGES.df(spark))


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in findings.SEVERITIES)
_FILLED = ", ".join(f"coalesce(n_{s.lower()}, 0) AS n_{s.lower()}" for s in findings.SEVERITIES)


@R.add(f"""
    WITH {_ISSUES}, {_POLICY}, one AS (SELECT *, row_number() OVER (PARTITION BY run_id, CASE WHEN coalesce(fingerprint, '') = '' THEN 'p' || pos ELSE fingerprint END ORDER BY n_evidence DESC, pos) AS rn FROM confirmed WHERE status IN ('SUCCEEDED', 'SUCCEEDED_WITH_WARNINGS')),
    c AS (SELECT run_id, {_COUNTS}, count(*) FILTER (confirm) AS n_confirm FROM one WHERE rn = 1 GROUP BY run_id),
    t AS (SELECT r.run_id, (SELECT count(*) FROM issues i WHERE i.run_id = r.run_id) AS n_issues, {_FILLED}, coalesce(n_confirm, 0) AS n_confirm FROM (SELECT DISTINCT run_id FROM st) r LEFT JOIN c USING (run_id))
    SELECT *, CASE WHEN n_issues > 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN n_blocker + n_critical > 0 THEN 'FAIL' WHEN n_major + n_minor > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS verdict FROM t""")
def severity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: findings by policy, collected, counted and judged."""
    return findings.verdicts(M.STAGES.df(spark), findings.collect(findings.visual_policy(M.FINDINGS.df(spark))))


_SECTION = "CASE " + " ".join(f"WHEN starts_with(rule_id, '{p}') THEN '{n}'" for n, p in reversed(findings.PREFIXES.items())) + " ELSE 'OTHER' END"


@R.add(f"WITH {_POLICY} SELECT run_id, {_SECTION} AS section, severity, count(*) AS n, count(*) FILTER (confirm) AS n_confirm FROM confirmed GROUP BY 1, 2, 3")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, F7."""
    return findings.report_sections(findings.visual_policy(M.FINDINGS.df(spark)))


@R.add("""SELECT event_id, sha256(event_type || chr(0) || user_id || chr(0) || event_id || chr(0) || coalesce(props, '')) AS fingerprint,
    sha256('{"rule_id":"' || event_type || '","artifact_refs":["' || user_id || '"],"target_refs":["a","b"],"evidence":null}') AS stable FROM events""")
def finding_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints A and B of §1.4 over all events."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", findings.fingerprint(F.col("event_type"), user, F.col("event_id").cast("string"), F.col("props")).alias("fingerprint"),
        findings.stable_fingerprint(F.col("event_type"), F.array(user), F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>")).alias("stable"),
    )
