"""Candidate processes found in evidence blocks, and whether the evidence of each is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.sources import markdown


def focus_filter(blocks: DataFrame, focus: str) -> DataFrame:
    """The blocks (heading_path, ...) under a heading that names the process."""
    return blocks.where(F.exists("heading_path", lambda h: F.array_contains(C.candidate_codes(F.upper(h)), focus.upper())))


def discover(blocks: DataFrame) -> DataFrame:
    """doc, process_key, n_blocks, line_start, line_end, name, level, complete of each process named in a heading of blocks (doc, kind, line_start, line_end, heading_path, content)."""
    told = blocks.withColumn("heading", F.explode("heading_path")).withColumn("process_key", F.explode(C.candidate_codes(F.upper("heading"))))
    last = F.element_at("heading_path", -1)
    # header and rows of a table block
    rows = F.filter(F.transform(F.filter(F.split("content", "\n"), lambda x: F.trim(x).startswith("|")), lambda x: markdown.cells(x)), lambda r: ~markdown.is_rule(r))
    header = F.array_join(F.get(rows, F.lit(0)), "|")
    table = F.col("kind") == "TABLE"
    activities = table & header.contains("活动") & header.contains("角色") & (F.size(rows) >= 3)
    flow = F.coalesce(last.rlike("控制流|顺序流"), F.lit(False)) | (table & header.contains("来源") & header.contains("目标"))
    end = F.coalesce(last.rlike("结束事件|开始与结束"), F.lit(False))
    level = F.upper(F.regexp_extract("heading", "(?i)(L[0-9]+)", 1))
    return told.groupBy("doc", "process_key").agg(
        F.countDistinct("line_start").alias("n_blocks"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.min_by(C.derived_name(F.col("heading"), F.col("process_key")), F.struct("line_start", "heading")).alias("name"),
        F.min_by(level, F.when(level != "", F.struct("line_start", "heading"))).alias("level"), (F.bool_or(F.coalesce(activities, F.lit(False))) & F.bool_or(F.coalesce(flow, F.lit(False))) & F.bool_or(end)).alias("complete"),
    )


def ordered(candidates: DataFrame) -> DataFrame:
    """candidates (grp, line_start, process_key, ...) with place: in the order of the document, those without a line last."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("line_start").asc_nulls_last(), "process_key")))
