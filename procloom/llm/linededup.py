"""Deduplication of lines across documents, with DataFrame functions only.

Each text is split at \\n. A line's key is the line without white space at both ends, A-Z in lower case,
and stands as two 64-bit hashes. A key of min_chars code points or more that at least two documents hold
loses all its lines except in the document with the smallest id: min and max of doc_id by key tell this with
partial aggregates, so a line that a third of all documents share makes no large group. Only positions of
dropped lines go back to the documents, whose other lines are joined again in order. Documents that lose no line pass by
that join: where few change, the positions go to all tasks, else a bitmap tells most of the others (up to some ten million that change),
and only texts that may change shuffle.

Texts: null and empty are one empty line. Texts of any length are taken whole. A document's own repeats of a key stay or go together. Rows that
repeat a doc_id count as one document for the rule, and each row gets its own result. A row without a doc_id
keeps all its lines. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the white space that keys lose at their ends.
BLANK = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), _UPPER, _LOWER)


def repeated_lines(docs: DataFrame, min_chars: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, pos, h1, h2) of every line with a key that counts; (h1, h2, keeper) of keys in two documents or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    hashed = shared.spill(hashed, "lines")
    held = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    return hashed, shared.spill(held.drop("last"), "held")  # apart from the join, whose rows of a frequent line can then be split over tasks


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of each row of docs."""
    with shared.scratch():
        hashed, held = repeated_lines(docs, min_chars)
        gone = hashed.join(held, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
        gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))  # positions of one text's lines
        gone = shared.spill(gone.withColumn("_key", F.xxhash64("doc_id", "text_hash")), "gone", outlast=1)
        n_gone, n_lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        if n_gone + n_lines <= shared.FEW:
            return _without(rows.join(F.broadcast(gone.drop("_key")), ["doc_id", "text_hash"], "left"))
    clear, maybe = shared.apart(rows.withColumn("_key", F.xxhash64("doc_id", "text_hash")), "_key", gone.select("_key"))
    changed = maybe.drop("_key").join(gone.drop("_key"), ["doc_id", "text_hash"], "left")
    return _without(changed).unionByName(_without(clear.withColumn("gone", F.lit(None).cast("array<int>"))))


def _without(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text, gone) without the lines at the positions in gone (null: none)."""
    rows = rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))  # once a text, as several columns use it
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))
