"""States of extraction tasks: validation of fragments, verdicts on workers' outputs, retries, caches, and routing of requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: attempts that a task gets.
MAX_ATTEMPTS = 3
#: Characters of an accepted fragment, and kinds of tasks.
MAX_FRAGMENT = 100_000
#: Words in a request that ask for more rights than it has; they are noted and never followed.
ESCALATION = ["忽略之前", "忽略以上", "忽略前述", "ignore previous", "安装", "覆盖", "发布", "提权", "install", "overwrite", "override", "publish", "npm", "registry"]
REVIEW_WORDS, DRAFT_WORDS, MEETING_WORDS = "(?i)评审|审查|检查|校验|review|inspect", "(?i)初稿|起草|draft", r"(?i)会议包|meeting\s*package"
#: Verbs and nouns that together ask for a draft.
DRAFT_VERBS, DRAFT_NOUNS = ["生成", "创建", "绘制", "转换", "产出", "画"], ["bpmn", "流程图", "流程草稿", "流程初稿"]
#: Routed methods, and whether each needs an output directory.
METHODS = {"review-integrated": False, "review-architecture": False, "review-diagram": False, "create-process-draft": True, "create-meeting-package": True}

_FRAGMENT = "batch_id string, task_kind string, facts array<struct<fact_id:string,certainty:string>>, uncertainties array<struct<kind:string,related_fact_ids:array<string>>>"


def fragment_errors(facts: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """frag, error of fragments: the first of DUPLICATE_FACT, DANGLING_REF, INFERRED_WITHOUT_CONTEXT. facts: frag, fact_id, certainty; uncertainties: frag, kind, related_fact_ids."""
    related = uncertainties.select("frag", "kind", F.explode("related_fact_ids").alias("fact_id"))
    twice = facts.groupBy("frag", "fact_id").agg(F.count("*").alias("n")).where("n > 1").select("frag", F.lit(1).alias("k"))
    lost = related.join(facts.select("frag", "fact_id"), ["frag", "fact_id"], "left_anti").select("frag", F.lit(2).alias("k"))
    told = related.where("kind = 'NEEDS_CONTEXT'").select("frag", "fact_id")
    bare = facts.where("certainty = 'INFERRED'").join(told, ["frag", "fact_id"], "left_anti").select("frag", F.lit(3).alias("k"))
    first = twice.unionByName(lost).unionByName(bare).groupBy("frag").agg(F.min("k").alias("k"))
    return first.select("frag", F.element_at(F.array(F.lit("DUPLICATE_FACT"), F.lit("DANGLING_REF"), F.lit("INFERRED_WITHOUT_CONTEXT")), F.col("k")).alias("error"))


def missing_evidence(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """frag, fact_id, ref of the evidence that facts (frag, batch_id, fact_id, evidence_refs) name and their batch (batch_id, block_id) lacks."""
    refs = facts.select("frag", "batch_id", "fact_id", F.explode("evidence_refs").alias("ref"))
    return refs.join(blocks.select("batch_id", F.col("block_id").alias("ref")).distinct(), ["batch_id", "ref"], "left_anti").select("frag", "fact_id", "ref")


def worker_verdicts(outputs: DataFrame) -> DataFrame:
    """outputs (raw, ...) with verdict (ACCEPT, RETRY or FAIL) and category: bad JSON, schema, inferred facts without context, then conflicts; the first counts."""
    kind = F.expr("schema_of_variant(try_parse_json(raw))")
    parsed = outputs.withColumn("j", F.from_json("raw", _FRAGMENT)).withColumn("is_object", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    facts, doubts = F.col("j.facts"), F.coalesce("j.uncertainties", F.array().cast("array<struct<kind:string,related_fact_ids:array<string>>>"))
    ids = F.transform(facts, lambda f: f["fact_id"])
    related = F.flatten(F.transform(doubts, lambda u: u["related_fact_ids"]))
    told = F.flatten(F.transform(F.filter(doubts, lambda u: u["kind"] == "NEEDS_CONTEXT"), lambda u: u["related_fact_ids"]))
    schema = F.col("j.batch_id").isNull() | F.col("j.task_kind").isNull() | facts.isNull() | F.exists(ids, lambda i: i.isNull()) | (F.size(F.array_distinct(ids)) < F.size(ids)) | (F.size(F.array_except(related, ids)) > 0)
    inferred = F.exists(facts, lambda f: (f["certainty"] == "INFERRED") & ~F.array_contains(told, f["fact_id"]))
    conflict = F.exists(facts, lambda f: f["certainty"] == "CONFLICT")
    category = F.when(~F.col("is_object"), "JSON_PARSE").when(F.coalesce(schema, F.lit(True)), "SCHEMA").when(F.coalesce(inferred, F.lit(False)), "INFERRED_MISSING_UNCERTAINTY").when(F.coalesce(conflict, F.lit(False)), "BUSINESS_CONFLICT")
    out = parsed.withColumn("category", category).drop("j", "is_object")
    return out.withColumn("verdict", F.when(F.col("category").isNull(), "ACCEPT").when(F.col("category") == "BUSINESS_CONFLICT", "FAIL").otherwise("RETRY"))


def task_outcomes(attempts: DataFrame) -> DataFrame:
    """task, outcome, n_attempts, category of tasks by their attempts (task, attempt from 1, verdict, category): the first that doesn't ask for a retry counts, of MAX_ATTEMPTS at most."""
    own = attempts.where(F.col("attempt") <= MAX_ATTEMPTS)
    last = own.groupBy("task").agg(F.min_by(F.struct("attempt", "verdict", "category"), F.when(F.col("verdict") != "RETRY", F.col("attempt"))).alias("f"), F.max_by(F.struct("attempt", "verdict", "category"), "attempt").alias("l"))
    outcome = F.when(F.col("f.verdict") == "ACCEPT", "ACCEPTED").when(F.col("f").isNotNull(), "FAILED").when(F.col("l.attempt") >= MAX_ATTEMPTS, "FAILED").otherwise("PENDING")
    return last.select("task", outcome.alias("outcome"), F.coalesce("f.attempt", "l.attempt").alias("n_attempts"), F.coalesce("f.category", F.when(F.col("f").isNull(), F.col("l.category"))).alias("category"))


def run_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """by, n_accepted, n_failed, n_pending, n_attempts."""
    n = lambda s: F.count_if(F.col("outcome") == s).alias(f"n_{s.lower()}")
    return outcomes.groupBy(*by).agg(n("ACCEPTED"), n("FAILED"), n("PENDING"), F.sum("n_attempts").alias("n_attempts"))


def cache_states(queue: DataFrame, batches: DataFrame, fragments: DataFrame) -> DataFrame:
    """queue (task_id, batch_id, status) with the status after a cache check and its reason. batches: batch_id, batch_sha256, content_hashes; fragments: task_id, batch_id, batch_sha256.

    A batch whose hash doesn't fit its contents takes all its tasks back to PENDING; a fragment that is missing or of another batch, its own. Accepted tasks that hold become CACHED."""
    good = F.sha2(F.array_join(F.array_sort("content_hashes"), ","), 256) == F.col("batch_sha256")
    checked = batches.select("batch_id", "batch_sha256", F.coalesce(good, F.lit(False)).alias("good"))
    own = fragments.select("task_id", F.col("batch_id").alias("f_batch"), F.col("batch_sha256").alias("f_sha"))
    told = queue.join(checked, "batch_id", "left").join(own, "task_id", "left")
    accepted = F.col("status") == "ACCEPTED"
    reason = (
        F.when(F.col("good").isNull(), "batch_missing").when(~F.col("good"), "hash_mismatch").when(accepted & F.col("f_batch").isNull(), "fragment_missing")
        .when(accepted & ((F.col("f_batch") != F.col("batch_id")) | (F.col("f_sha") != F.col("batch_sha256"))), "fragment_hash_mismatch")
    )
    told = told.withColumn("reason", reason)
    return told.select("task_id", "batch_id", F.when(F.col("reason").isNotNull(), "PENDING").when(accepted, "CACHED").otherwise(F.col("status")).alias("status"), "reason")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def select_route(explicit: Column, architecture: Column, diagram: Column) -> Column:
    a, d = F.coalesce(architecture, F.lit(0)) > 0, F.coalesce(diagram, F.lit(0)) > 0
    fits = F.when(explicit == "INTEGRATED", a & d).when(explicit == "ARCHITECTURE_ONLY", a).when(explicit == "DIAGRAM_ONLY", d).otherwise(F.lit(False))
    auto = F.when(a & d, "INTEGRATED").when(a, "ARCHITECTURE_ONLY").when(d, "DIAGRAM_ONLY").otherwise("NEEDS_INPUT")
    return F.when(F.coalesce(explicit, F.lit("")) != "", F.when(fits, explicit).otherwise("NEEDS_INPUT")).otherwise(auto)


def asks_for_draft(request: Column) -> Column:
    """A verb that isn't an attribute (followed by 的) and a noun of drafts."""
    text = F.lower(F.coalesce(request, F.lit("")))
    verb = text.rlike("(?:" + "|".join(DRAFT_VERBS) + ")(?!的)")
    noun = F.exists(F.array(*map(F.lit, DRAFT_NOUNS)), lambda n: F.contains(text, n))
    return verb & noun


def quickstart(requests: DataFrame) -> DataFrame:
    """requests (request, intent, architecture_count, diagram_count, has_v2_draft, output_dir, user_choice, ...) with candidates, status, selected, missing_key and directives that were ignored."""
    text = F.coalesce("request", F.lit(""))
    a, d = F.col("architecture_count") > 0, F.col("diagram_count") > 0
    one = lambda m: F.array(F.lit(m))
    none = F.array().cast("array<string>")
    review = F.when(a & d, one("review-integrated")).when(a, one("review-architecture")).when(d, one("review-diagram")).otherwise(none)
    draft, meeting, asked = text.rlike(DRAFT_WORDS) | asks_for_draft(text), text.rlike(MEETING_WORDS), text.rlike(REVIEW_WORDS)
    some = lambda cond, m: F.when(cond, one(m)).otherwise(none)
    found = (
        F.when(F.col("intent") == "REVIEW", review).when(F.col("intent") == "CREATE_DRAFT", one("create-process-draft")).when(F.col("intent") == "CREATE_MEETING_PACKAGE", one("create-meeting-package"))
        .when((draft | meeting) & ~asked, F.concat(some(draft, "create-process-draft"), some(meeting, "create-meeting-package"))).when(asked & ~draft & ~meeting, review)
        .otherwise(F.concat(review, some(a | d, "create-process-draft"), some(F.col("has_v2_draft"), "create-meeting-package")))
    )
    chosen = F.when(F.col("user_choice").isNull(), F.col("found")).when(F.array_contains("found", F.col("user_choice")), F.array("user_choice")).otherwise(none)
    told = requests.withColumn("found", found).withColumn("candidates", chosen)
    told = told.withColumn("ignored", F.filter(F.array(*map(F.lit, ESCALATION)), lambda k: F.contains(F.lower(F.coalesce("request", F.lit(""))), k)))
    method = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
    creates = method.isin(*[m for m, needs in METHODS.items() if needs])
    missing = F.when(creates & (F.coalesce("output_dir", F.lit("")) == ""), "output_dir").when((method == "create-meeting-package") & ~F.col("has_v2_draft"), "v2_draft")
    hostile = creates & (F.size("ignored") > 0) & F.col("intent").isNull()
    status = F.when(F.size("candidates") == 0, "NO_MATCH").when(F.size("candidates") > 1, "NEEDS_CHOICE").when(missing.isNotNull(), "MISSING_INFO").when(hostile, "NEEDS_CHOICE").otherwise("ROUTED")
    told = told.withColumn("missing_key", missing).withColumn("status", status).withColumn("method", method)
    return told.withColumn("selected", F.when(F.col("status") == "ROUTED", F.col("method"))).drop("found", "method")


def focus_question(candidates: DataFrame) -> DataFrame:
    """run, n, options of runs with more than one candidate process (run, process_key, name)."""
    return candidates.groupBy("run").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("process_key")).alias("options")).where("n > 1")


def accept_fragments(fragments: DataFrame, batches: DataFrame) -> DataFrame:
    """task_id, error of fragments (task_id, raw): the first of TOO_LARGE, NOT_JSON, NO_ENVELOPE, UNKNOWN_BATCH, HASH_MISMATCH, UNKNOWN_EVIDENCE, or null if the fragment is accepted.
    batches: batch_id, batch_sha256, block_ids."""
    spec = "batch_id string, batch_sha256 string, task_kind string, facts array<struct<evidence_refs:array<string>>>"
    told = fragments.select("task_id", "raw", F.from_json("raw", spec).alias("j"), F.expr("try_parse_json(raw) is not null and schema_of_variant(try_parse_json(raw)) like 'OBJECT%'").alias("json"))
    told = told.select("task_id", "raw", "json", "j.*").join(batches.select(F.col("batch_id"), F.col("batch_sha256").alias("sha"), "block_ids"), "batch_id", "left")
    refs = F.flatten(F.transform(F.coalesce("facts", F.array().cast("array<struct<evidence_refs:array<string>>>")), lambda f: F.coalesce(f["evidence_refs"], F.array().cast("array<string>"))))
    lost = F.exists(refs, lambda r: ~F.array_contains("block_ids", r))
    error = (
        F.when(F.length("raw") > MAX_FRAGMENT, "TOO_LARGE").when(~F.coalesce("json", F.lit(False)), "NOT_JSON").when(F.col("batch_id").isNull() | F.col("batch_sha256").isNull() | F.col("task_kind").isNull(), "NO_ENVELOPE")
        .when(F.col("sha").isNull(), "UNKNOWN_BATCH").when(F.col("sha") != F.col("batch_sha256"), "HASH_MISMATCH").when(lost, "UNKNOWN_EVIDENCE")
    )
    return told.select("task_id", error.alias("error"))


def reusable(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """task_id, reason of wanted tasks (task_id, cache_key, versions, params) against a cache's entries (cache_key, versions, params): MISSING, VERSION, PARAMS, or null if the entry holds."""
    own = entries.select("cache_key", F.col("versions").alias("had_versions"), F.col("params").alias("had_params"), F.lit(True).alias("had"))
    told = wanted.join(own, "cache_key", "left")
    return told.select("task_id", F.when(F.col("had").isNull(), "MISSING").when(~F.col("versions").eqNullSafe(F.col("had_versions")), "VERSION").when(~F.col("params").eqNullSafe(F.col("had_params")), "PARAMS").alias("reason"))


# --- Schemas: what a column must be, given as data


@dataclass(frozen=True)
class Field:
    """A column's rules: required, a set of values, a pattern, bounds of a number or of a length."""

    name: str
    required: bool = False
    values: tuple[str, ...] = ()
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    longest: int | None = None


def schema_problems(rows: DataFrame, key: str, fields: Sequence[Field]) -> DataFrame:
    """key, field, problem for every rule that a row breaks, all of them: MISSING, ENUM, PATTERN, MINIMUM, MAXIMUM or TOO_LONG."""
    found = []
    for f in fields:
        c = F.col(f.name)
        broken = {"MISSING": c.isNull() if f.required else None, "ENUM": ~c.isin(*f.values) if f.values else None, "PATTERN": ~c.rlike(f.pattern) if f.pattern else None,
                  "MINIMUM": c < f.least if f.least is not None else None, "MAXIMUM": c > f.most if f.most is not None else None, "TOO_LONG": F.length(c) > f.longest if f.longest is not None else None}
        found += [F.when(test, F.struct(F.lit(f.name).alias("field"), F.lit(problem).alias("problem"))) for problem, test in broken.items() if test is not None]
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("p")).select("key", "p.*")
