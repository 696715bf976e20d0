"""Queries on tasks, caches and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procloom.operators import state
from procloom.plans import models as M
from procloom.plans.registry import Registry, table

R = Registry()


@R.add(f"""
    WITH f AS (SELECT frag_idx AS frag, fact_id, certainty FROM {M.FACTS.sql}), r AS (SELECT frag_idx AS frag, kind, unnest(related_fact_ids) AS fact_id FROM {M.UNCERTAINTIES.sql}),
    e AS (SELECT frag, 1 AS k FROM f GROUP BY frag, fact_id HAVING count(*) > 1
        UNION ALL SELECT frag, 2 FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.frag = r.frag AND f.fact_id = r.fact_id)
        UNION ALL SELECT frag, 3 FROM f WHERE certainty = 'INFERRED' AND NOT EXISTS (SELECT 1 FROM r WHERE r.frag = f.frag AND r.fact_id = f.fact_id AND r.kind = 'NEEDS_CONTEXT'))
    SELECT frag, ['DUPLICATE_FACT', 'DANGLING_REF', 'INFERRED_WITHOUT_CONTEXT'][min(k)] AS error FROM e GROUP BY frag""")
def fragment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V5."""
    return state.fragment_errors(M.FACTS.df(spark).withColumnRenamed("frag_idx", "frag"), M.UNCERTAINTIES.df(spark).withColumnRenamed("frag_idx", "frag"))


@R.add(f"""
    SELECT task, attempt, category, CASE WHEN category IS NULL THEN 'ACCEPT' WHEN category = 'BUSINESS_CONFLICT' THEN 'FAIL' ELSE 'RETRY' END AS verdict FROM (
        SELECT task, attempt, CASE WHEN NOT json_valid(raw) OR json_type(raw) <> 'OBJECT' OR raw IS NULL THEN 'JSON_PARSE'
            WHEN raw::JSON->>'batch_id' IS NULL OR (SELECT count(*) <> count(DISTINCT f) FROM (SELECT unnest(json_extract_string(raw, '$.facts[*].fact_id')) AS f)) OR raw LIKE '%"q"%' THEN 'SCHEMA'
            WHEN raw LIKE '%INFERRED%' AND raw NOT LIKE '%NEEDS_CONTEXT%' THEN 'INFERRED_MISSING_UNCERTAINTY' WHEN raw LIKE '%"CONFLICT"%' THEN 'BUSINESS_CONFLICT' END AS category
        FROM (SELECT task, attempt, CASE WHEN json_valid(raw) THEN raw ELSE '[]' END AS raw FROM {M.WORKER_OUTPUTS.sql}))""")
def worker_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return state.worker_verdicts(M.WORKER_OUTPUTS.df(spark)).select("task", "attempt", "category", "verdict")


_VERDICT = "CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'error' THEN 'FAIL' ELSE 'RETRY' END"
_RUNS = f"""att AS (SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, {_VERDICT} AS verdict, event_type AS category FROM events),
    own AS (SELECT * FROM att WHERE attempt <= 3), fin AS (SELECT task, arg_min({{'a': attempt, 'v': verdict, 'c': category}}, attempt) FILTER (verdict <> 'RETRY') AS f, arg_max({{'a': attempt, 'v': verdict, 'c': category}}, attempt) AS l FROM own GROUP BY task),
    outcomes AS (SELECT task, CASE WHEN f.v = 'ACCEPT' THEN 'ACCEPTED' WHEN f IS NOT NULL THEN 'FAILED' WHEN l.a >= 3 THEN 'FAILED' ELSE 'PENDING' END AS outcome, coalesce(f.a, l.a) AS n_attempts, CASE WHEN f IS NULL THEN l.c ELSE f.c END AS category FROM fin)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as attempts at one task."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    verdict = F.when(F.col("event_type") == "purchase", "ACCEPT").when(F.col("event_type") == "error", "FAIL").otherwise("RETRY")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), number.alias("attempt"), verdict.alias("verdict"), F.col("event_type").alias("category"))


@R.add(f"WITH {_RUNS} SELECT * FROM outcomes")
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4."""
    return state.task_outcomes(attempts(spark, sf_dir))


@R.add(f"WITH {_RUNS} SELECT task % 10 AS shard, count(*) FILTER (outcome = 'ACCEPTED') AS n_accepted, count(*) FILTER (outcome = 'FAILED') AS n_failed, count(*) FILTER (outcome = 'PENDING') AS n_pending, sum(n_attempts)::BIGINT AS n_attempts FROM outcomes GROUP BY 1")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return state.run_report(state.task_outcomes(attempts(spark, sf_dir)).withColumn("shard", F.col("task") % 10), ["shard"])


_CACHE = """b AS (SELECT source || '/' || lang || '/' || doc_id // 500 AS batch_id, list_sort(list(sha256(coalesce(text, '')))) AS hashes, min(doc_id) AS k FROM documents GROUP BY 1),
    bb AS (SELECT batch_id, sha256(array_to_string(hashes, ',')) AS good, CASE WHEN k % 5 = 0 THEN 'bad' ELSE sha256(array_to_string(hashes, ',')) END AS batch_sha256, k FROM b),
    q AS (SELECT batch_id || ':' || t AS task_id, batch_id, CASE WHEN (k + t) % 2 = 0 THEN 'ACCEPTED' ELSE 'PENDING' END AS status, k, t FROM b CROSS JOIN range(3) AS r(t)),
    f AS (SELECT batch_id || ':' || t AS task_id, batch_id, CASE WHEN k % 7 = 0 THEN 'old' ELSE batch_sha256 END AS sha FROM bb CROSS JOIN range(2) AS r(t))"""


@R.add(f"""
    WITH {_CACHE}, j AS (SELECT q.task_id, q.batch_id, q.status, CASE WHEN bb.batch_sha256 <> bb.good THEN 'hash_mismatch' WHEN q.status = 'ACCEPTED' AND f.task_id IS NULL THEN 'fragment_missing' WHEN q.status = 'ACCEPTED' AND f.sha <> bb.batch_sha256 THEN 'fragment_hash_mismatch' END AS reason FROM q JOIN bb USING (batch_id) LEFT JOIN f ON f.task_id = q.task_id)
    SELECT task_id, batch_id, CASE WHEN reason IS NOT NULL THEN 'PENDING' WHEN status = 'ACCEPTED' THEN 'CACHED' ELSE status END AS status, reason FROM j""")
def cache_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 500 ids of a source and language are a batch of three tasks; some hashes and fragments are wrong or missing."""
    docs = table(spark, sf_dir, "documents")
    b = docs.groupBy(F.concat_ws("/", "source", "lang", F.expr("doc_id div 500").cast("string")).alias("batch_id")).agg(F.array_sort(F.collect_list(F.sha2(F.coalesce("text", F.lit("")), 256))).alias("content_hashes"), F.min("doc_id").alias("k"))
    good = F.sha2(F.array_join("content_hashes", ","), 256)
    b = b.withColumn("batch_sha256", F.when(F.col("k") % 5 == 0, "bad").otherwise(good))
    each = lambda n: b.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("task_id", F.concat("batch_id", F.lit(":"), F.col("t").cast("string")))
    queue = each(3).select("task_id", "batch_id", F.when((F.col("k") + F.col("t")) % 2 == 0, "ACCEPTED").otherwise("PENDING").alias("status"))
    fragments = each(2).select("task_id", "batch_id", F.when(F.col("k") % 7 == 0, "old").otherwise(F.col("batch_sha256")).alias("batch_sha256"))
    return state.cache_states(queue, b.select("batch_id", "batch_sha256", "content_hashes"), fragments)


@R.add("""SELECT source, doc_id // 500 AS run, sha256('{"version":"1","inputs":' || '["' || array_to_string(list_sort(list(sha256(coalesce(text, '')))), '","') || '"],"focus":null}') AS cache_key FROM documents GROUP BY 1, 2""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of §1.4: each 500 ids of a source are the inputs of a run, in order of their hashes."""
    docs = table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 500").alias("run")).agg(F.array_sort(F.collect_list(F.sha2(F.coalesce("text", F.lit("")), 256))).alias("inputs"))
    return docs.select("source", "run", state.cache_key(F.lit("1").alias("version"), F.col("inputs"), F.lit(None).cast("string").alias("focus")).alias("cache_key"))


@R.add(f"""
    SELECT id, CASE WHEN coalesce(explicit, '') <> '' THEN CASE WHEN (explicit = 'INTEGRATED' AND architecture > 0 AND diagram > 0) OR (explicit = 'ARCHITECTURE_ONLY' AND architecture > 0) OR (explicit = 'DIAGRAM_ONLY' AND diagram > 0) THEN explicit ELSE 'NEEDS_INPUT' END
        WHEN architecture > 0 AND diagram > 0 THEN 'INTEGRATED' WHEN architecture > 0 THEN 'ARCHITECTURE_ONLY' WHEN diagram > 0 THEN 'DIAGRAM_ONLY' ELSE 'NEEDS_INPUT' END AS route FROM {M.ROUTES.sql}""")
def select_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8."""
    return M.ROUTES.df(spark).select("id", state.select_route(F.col("explicit"), F.col("architecture"), F.col("diagram")).alias("route"))


_VERB = " OR ".join(f"(len(string_split(low, '{v}')) > len(string_split(low, '{v}的')))" for v in state.DRAFT_VERBS)
_NOUN = " OR ".join(f"contains(low, '{n}')" for n in state.DRAFT_NOUNS)
_IGNORED = ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{k}' END" for k in state.ESCALATION)


@R.add(f"""
    WITH q AS (SELECT *, lower(coalesce(request, '')) AS low FROM {M.REQUESTS.sql}),
    s AS (SELECT *, CASE WHEN architecture_count > 0 AND diagram_count > 0 THEN ['review-integrated'] WHEN architecture_count > 0 THEN ['review-architecture'] WHEN diagram_count > 0 THEN ['review-diagram'] ELSE [] END AS review,
        regexp_matches(low, '初稿|起草|draft') OR (({_VERB}) AND ({_NOUN})) AS draft, regexp_matches(low, '会议包|meeting\\s*package') AS meeting, regexp_matches(low, '评审|审查|检查|校验|review|inspect') AS asked, list_filter([{_IGNORED}], lambda k: k IS NOT NULL) AS ignored FROM q),
    t AS (SELECT *, CASE WHEN intent = 'REVIEW' THEN review WHEN intent = 'CREATE_DRAFT' THEN ['create-process-draft'] WHEN intent = 'CREATE_MEETING_PACKAGE' THEN ['create-meeting-package']
        WHEN (draft OR meeting) AND NOT asked THEN list_concat(CASE WHEN draft THEN ['create-process-draft'] ELSE [] END, CASE WHEN meeting THEN ['create-meeting-package'] ELSE [] END) WHEN asked AND NOT draft AND NOT meeting THEN review
        ELSE list_concat(review, CASE WHEN architecture_count + diagram_count > 0 THEN ['create-process-draft'] ELSE [] END, CASE WHEN has_v2_draft THEN ['create-meeting-package'] ELSE [] END) END AS found FROM s),
    u AS (SELECT *, CASE WHEN user_choice IS NULL THEN found WHEN list_contains(found, user_choice) THEN [user_choice] ELSE [] END AS candidates FROM t),
    v AS (SELECT *, CASE WHEN len(candidates) = 1 THEN candidates[1] END AS method FROM u),
    w AS (SELECT *, CASE WHEN method LIKE 'create-%' AND coalesce(output_dir, '') = '' THEN 'output_dir' WHEN method = 'create-meeting-package' AND NOT has_v2_draft THEN 'v2_draft' END AS missing_key FROM v),
    x AS (SELECT *, CASE WHEN len(candidates) = 0 THEN 'NO_MATCH' WHEN len(candidates) > 1 THEN 'NEEDS_CHOICE' WHEN missing_key IS NOT NULL THEN 'MISSING_INFO' WHEN method LIKE 'create-%' AND len(ignored) > 0 AND intent IS NULL THEN 'NEEDS_CHOICE' ELSE 'ROUTED' END AS status FROM w)
    SELECT id, candidates, status, missing_key, CASE WHEN status = 'ROUTED' THEN method END AS selected, ignored FROM x""")
def quickstart_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9, F9, C22."""
    return state.quickstart(M.REQUESTS.df(spark)).select("id", "candidates", "status", "missing_key", "selected", "ignored")


@R.add("SELECT source AS run, count(DISTINCT lang) AS n, list_sort(list(DISTINCT lang)) AS options FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def focus_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a source as its candidates."""
    return state.focus_question(table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("lang").alias("process_key")).distinct())
