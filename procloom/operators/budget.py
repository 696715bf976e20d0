"""Token budgets: sums by group, states, estimates before packing, and the tasks that packed batches give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators.joins import null_safe
from procloom.operators.packing import NO_LIMIT, greedy

#: Kinds of extraction task that each batch gets.
TASK_KINDS = ["PROCESS_CARD", "ACTIVITY_CATALOG", "CONTROL_FLOW"]
#: Formats whose blocks can be counted before they are read, and bounds of blocks in a file of any other use.
EXACT_FORMATS = [".md", ".bpmn", ".svg", ".mmd", ".mermaid"]
TEXT_BLOCKS, OTHER_BLOCKS = (3, 30), (1, 8)
BLOCKS_PER_BATCH = 12


def context_budgets(texts: DataFrame, limit: int) -> DataFrame:
    """grp, fixed, content, metadata, total, ratio, status of texts (grp, role, text): the sum of each text's own estimate, by role."""
    told = texts.select("grp", "role", C.estimate_tokens(F.col("text")).alias("tokens"))  # once, not for each role
    part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("tokens"))), F.lit(0)).alias(r)
    out = told.groupBy("grp").agg(*[part(r) for r in ("fixed", "content", "metadata")])
    out = out.withColumn("total", F.col("fixed") + F.col("content") + F.col("metadata"))
    return out.withColumn("ratio", F.round(F.col("total") / F.lit(float(limit)), 6)).withColumn("status", C.budget_status(F.col("total").cast("double"), F.lit(float(limit))))


def queue_tasks(batches: DataFrame, limit_tokens: int) -> DataFrame:
    """grp, batch_no, task_kind, status: a task of each kind for each batch (grp, batch_no, tokens); a batch over budget must be split first."""
    split = C.budget_status(F.col("tokens").cast("double"), F.lit(float(limit_tokens))) == C.BUDGET_SPLIT
    return batches.select("grp", "batch_no", F.explode(F.array(*map(F.lit, TASK_KINDS))).alias("task_kind"), F.when(split, "SPLIT_REQUIRED").otherwise("PENDING").alias("status"))


def estimate_range(files: DataFrame) -> DataFrame:
    """grp, estimate, blocks and batches and tasks (least, most) of files (grp, extension, n_blocks). Known formats count exactly; others give a range."""
    known = F.col("extension").isin(*EXACT_FORMATS)
    safe = F.col("extension").isin(*EXACT_FORMATS, ".txt", ".csv")
    low = F.when(safe, TEXT_BLOCKS[0]).otherwise(OTHER_BLOCKS[0])
    high = F.when(safe, TEXT_BLOCKS[1]).otherwise(OTHER_BLOCKS[1])
    told = files.groupBy("grp").agg(F.bool_and(known).alias("exact"), F.sum("n_blocks").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    batches = lambda c: F.ceil(c / F.lit(BLOCKS_PER_BATCH)).cast("long")
    least, most = F.when(F.col("exact"), F.col("n")).otherwise(F.col("low")), F.when(F.col("exact"), F.col("n")).otherwise(F.col("high"))
    return told.select(
        "grp", F.when(F.col("exact"), "EXACT").otherwise("HEURISTIC_RANGE").alias("estimate"), least.cast("long").alias("min_blocks"), most.cast("long").alias("max_blocks"),
        batches(least).alias("min_batches"), batches(most).alias("max_batches"), (batches(least) * len(TASK_KINDS)).alias("min_tasks"), (batches(most) * len(TASK_KINDS)).alias("max_tasks"),
    )


def deviation(actual: Column, least: Column, most: Column) -> Column:
    """How an actual count stands to its estimate."""
    return F.when((least == most) & (actual == least), "EQUAL").when(actual.between(least, most), "IN_RANGE").otherwise("OUT_OF_RANGE")


def aggregation_tasks(results: DataFrame, max_tokens: int) -> DataFrame:
    """grp, task_no, task_id, n_results, tokens, status: results (grp, ord, result_id, tokens) folded in order into tasks. One over 1.2 times the limit is BLOCKED."""
    units = results.select("grp", "ord", F.lit(1).cast("long").alias("blocks"), F.col("tokens").alias("chars"))
    rows = null_safe(results, greedy(units, NO_LIMIT, max_tokens), ["grp", "ord"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "result_id"))), lambda x: x["result_id"]), ",")  # as many as max_tokens allows
    out = rows.groupBy("grp", F.col("batch_no").alias("task_no")).agg(C.prefixed_id("AGG", ids).alias("task_id"), F.count("*").alias("n_results"), F.sum("tokens").alias("tokens"))
    return out.withColumn("status", F.when(F.col("tokens") > int(max_tokens * 1.2), "BLOCKED").otherwise("RUNNABLE"))


def refinement_groups(chunks: DataFrame, max_chars: int = 14400) -> DataFrame:
    """grp, ord, batch_no of the chunks (grp, ord, domain_tags, content) without tags, in groups of max_chars at most."""
    own = chunks.where(F.size("domain_tags") == 0)
    return greedy(own.select("grp", "ord", F.lit(1).cast("long").alias("blocks"), C.utf16_length(F.col("content")).alias("chars")), NO_LIMIT, max_chars)


def rule_packet(wanted: DataFrame, sections: DataFrame, limit: int = 2000) -> DataFrame:
    """rule_id, found, tokens, status of the wanted rules by their sections (rule_id, content); the packet of all must keep to the limit."""
    told = wanted.join(sections, "rule_id", "left").select("rule_id", F.col("content").isNotNull().alias("found"), C.estimate_tokens(F.col("content")).alias("tokens"))
    packet = told.agg(F.sum("tokens").alias("packet_tokens"), F.collect_list(F.struct(*told.columns)).alias("rules"))  # as many as rules are wanted
    return packet.select("packet_tokens", F.inline("rules")).withColumn("status", C.budget_status(F.col("packet_tokens").cast("double"), F.lit(float(limit))))


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (grp, name, sha, chunk_id) with place: their order in their group by name as people sort it (case and accents last), then sha and id."""
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.collate(F.col("name"), "UNICODE"), "sha", "chunk_id")))


def stage_tasks(packets: DataFrame) -> DataFrame:
    """packets (status, budget_status, ...) with runnable."""
    return packets.withColumn("runnable", (F.col("status") != "BLOCKED") & (F.col("budget_status") != C.BUDGET_SPLIT))
