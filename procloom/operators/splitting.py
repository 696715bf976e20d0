"""Cutting of oversized text blocks: by paragraphs, then lines, then characters. Lengths are UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.functions import columns as C

#: Limits of an evidence batch.
MAX_CHARS, MAX_BLOCKS = 12000, 12


def _append(done: Column, text: Column) -> Column:
    return F.when(F.trim(text) != "", F.concat(done, F.array(text))).otherwise(done)


def greedy_join(parts: Column, separator: str, limit: int) -> Column:
    """Join neighbouring parts by separator as long as the text stays within limit; a longer part stands alone. Blank texts are dropped; texts are as joined, untrimmed."""
    # the length goes along, so that a text that grows isn't measured anew for each part
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, part: Column) -> Column:
        size = F.struct(C.utf16_length(part).alias("n"), part.alias("t"))
        return F.get(F.transform(F.array(size), lambda p: grown(acc, p)), 0)

    def grown(acc: Column, part: Column) -> Column:
        empty = acc["now"] == ""
        total = acc["n"] + part["n"] + len(separator)
        full = (total > limit) & ~empty
        fresh = full | empty
        more = F.when(fresh, part["t"]).otherwise(F.concat(acc["now"], F.lit(separator), part["t"]))
        return F.struct(F.when(full, _append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), more.alias("now"), F.when(fresh, part["n"]).otherwise(total).alias("n"))

    return F.aggregate(parts, start, step, lambda acc: _append(acc["done"], acc["now"]))


def by_paragraphs(text: Column, limit: int) -> Column:
    parts = F.filter(F.transform(F.split(text, "\n{2,}"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    return greedy_join(parts, "\n\n", limit)


def by_lines(text: Column, limit: int) -> Column:
    return F.transform(greedy_join(F.split(text, "\n"), "\n", limit), lambda t: F.trim(t, F.lit(" \t\r\n")))


def by_chars(text: Column, limit: int) -> Column:
    """Slices of limit code points; the last may be shorter."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(limit))
    return F.when(n == 0, F.array(text)).otherwise(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(limit))))


def fragments(text: Column, limit: int = MAX_CHARS) -> Column:
    """Fragments of a text over limit, else the text alone."""
    too_long = lambda t: C.utf16_length(t) > limit
    lines = lambda t: F.flatten(F.transform(by_lines(t, limit), lambda u: F.when(too_long(u), by_chars(u, limit)).otherwise(F.array(u))))
    cut = F.flatten(F.transform(by_paragraphs(text, limit), lambda t: F.when(too_long(t), lines(t)).otherwise(F.array(t))))
    whole = F.array(text)
    return F.when(too_long(text), F.get(F.transform(F.array(cut), lambda x: F.when(F.size(x) > 0, x).otherwise(whole)), 0)).otherwise(whole)


def split_blocks(blocks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """One row a fragment: the columns of blocks (block_id, artifact_sha256, content, ...), with fragment, offset, and new ids and hashes where a block was cut.

    An offset counts the fragments before it, as joined; it names the fragment and is no place in the source."""
    cut = blocks.withColumn("parts", fragments(F.col("content"), limit))
    rows = cut.select("*", F.posexplode("parts").alias("fragment", "part"))
    before = F.aggregate(F.slice("parts", 1, F.col("fragment")), F.lit(0).cast("long"), lambda acc, t: acc + C.utf16_length(t))
    split = F.size("parts") > 1
    child = C.block_id(F.col("artifact_sha256"), F.concat_ws(":", "block_id", before.cast("string")))
    rows = rows.withColumn("offset", before).withColumn("id", F.when(split, child).otherwise(F.col("block_id"))).withColumn("content", F.col("part"))
    return rows.drop("parts", "part").withColumn("content_sha256", F.sha2("content", 256)).withColumn("block_id", F.col("id")).drop("id")
