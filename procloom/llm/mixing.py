"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

The total is shared by weight. A source whose share exceeds its cap (max_epochs times its size) is clamped
there and the excess goes to the others by weight, again and again until none exceeds its cap. Filling is
monotone in one level, so the end is found without a loop: with sources in the order of cap / weight, a
source is clamped exactly if the water level that would clamp it is still affordable.

Every document is taken a whole number of times, plus once more for a fraction of the words: a source's
large documents (each over 1 in 512 of its words, so at most 512 of them) are taken in a seeded order, each that
fits into the fraction of their words, and the small ones in order for what is left. Among the small ones the
order is a seeded hash; sums by hash bucket tell all but one bucket apart without sorting a source, and
only that bucket's rows are ordered. So what a source gives is within half a small document of its target,
no document exceeds max_epochs times its size, and reruns agree.

Rows: texts of any length are sized whole, and ties of words are decided by the seeded hash, then doc_id. A null text has size 0 and is taken at no cost or gain (0 words). A null source is a source of its
own, last in order. Rows that repeat count each. Sources without words have target 0. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procloom.llm import shared

BUCKETS = 4096
LARGE = 512


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target by source. sizes has source and size; weights repeat along the sources in code point order, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on, so windows over all of them hold as many rows as there are sources.
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    up = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    # water needed to bring everyone to the level at which this source is full
    level = F.col("cap") / F.col("weight")
    per = per.withColumn("below", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = per.withColumn("rest", F.sum("weight").over(up.rowsBetween(1, Window.unboundedFollowing)))
    per = per.withColumn("full", F.col("below") + level * F.coalesce("rest", F.lit(0.0)) <= F.col("total"))
    free = F.greatest(F.lit(0.0), F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every))
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), free * F.col("weight") / F.nullif(open_weight, F.lit(0.0))))
    return per.select("source", "source_size", target.alias("target"))


def _tie(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("size")]


def _decide(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each row's sizes, copies, and whether it is listed (the copies of all others follow from its source and bucket); and by source whole, last and some: what they follow from."""
    sized = shared.spill(docs.select("doc_id", "source", shared.n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    per = shared.spill(targets(sized, weights, share, max_epochs), "targets")
    one = per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    one = one.withColumn("whole", F.floor(F.least("rate", F.lit(float(max_epochs))))).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    hot = F.xxhash64(F.lit(seed), "doc_id")
    rows = sized.join(one.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("large", F.col("size") * LARGE > F.col("source_size")).withColumn("bucket", F.when(F.col("large"), -1).otherwise(bucket_of(seed)))

    # large documents: at most LARGE a source, in seeded order; each is taken that still fits into the fraction of their words
    many = rows.where("large").groupBy("source").agg(F.array_sort(F.collect_list(F.struct(hot.alias("at"), "doc_id", "row", "size"))).alias("docs"), F.sum("size").alias("words"), F.first(F.col("extra") / F.col("source_size")).alias("fraction"))
    start = F.struct(F.lit(0).cast("long").alias("got"), F.array().cast("array<bigint>").alias("rows"))
    slack = F.array_min(F.transform("docs", lambda d: d["size"])) / 2
    fits = lambda had, d: had["got"] + d["size"] <= F.col("words") * F.col("fraction") + slack
    took = F.aggregate("docs", start, lambda had, d: F.when(fits(had, d), F.struct((had["got"] + d["size"]).alias("got"), F.concat(had["rows"], F.array(d["row"])).alias("rows"))).otherwise(had))
    chosen = shared.spill(many.select("source", took.alias("t")).select("source", "t.*"), "large")
    large = rows.where("large").join(chosen.select(F.explode("rows").alias("at")), F.col("row") == F.col("at"), "left").withColumn("more", F.col("at").isNotNull())
    got = chosen.select("source", "got")

    # small documents: whole buckets up to the one where the sum passes what is left
    sums = rows.where("not large").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"))
    left = sums.join(got.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    left = left.withColumn("left", F.greatest(F.lit(0.0), F.col("extra") - F.coalesce("got", F.lit(0))))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    buckets = shared.spill(left.select("source", "bucket", F.col("left"), (upto - F.col("words")).alias("before"), upto.alias("after")), "buckets")
    edge = buckets.where("before < left and after > left").select(F.col("source").alias("of"), F.col("bucket").alias("edge"), "left", "before")
    cut = buckets.where("after <= left").groupBy(F.col("source").alias("of")).agg(F.max("bucket").alias("last"))
    rule = one.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").join(edge.select("of", "edge"), F.col("source").eqNullSafe(F.col("of")), "left")
    rule = shared.spill(rule.select("source", "whole", F.coalesce("last", F.lit(-1)).alias("last"), (F.col("extra") > 0).alias("some"), "edge"), "rules", outlast=1)

    by = rule.select(F.col("source").alias("of"), "last", "edge")
    small = rows.where("not large").join(by, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    small = small.withColumn("more", (F.col("bucket") <= F.col("last")) & (F.col("extra") > 0))
    border = rows.where("not large").join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("edge")))
    inside = Window.partitionBy("source", "bucket").orderBy(*_tie(seed), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = border.withColumn("more_here", F.col("before") + F.sum("size").over(inside) - F.col("size") / 2 <= F.col("left")).where("more_here").select(F.col("row").alias("at"))
    small = small.join(border, F.col("row") == F.col("at"), "left").withColumn("more", F.col("more") | F.col("at").isNotNull())
    keep = ["doc_id", "source", "size", "source_size", "target", "whole", "more"]
    out = large.select(*keep, F.lit(True).alias("listed")).unionByName(small.select(*keep, F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False)).alias("listed")))
    copies = F.least(F.col("whole") + F.col("more").cast("long"), F.lit(int(max_epochs)))
    return out.withColumn("copies", copies.cast("long")), rule


def bucket_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies times size) of each row of docs."""
    with shared.scratch():
        out, _ = _decide(docs, weights, share, max_epochs, seed)
        return shared.spill(out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), "mix", outlast=1)


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns. doc_id must tell rows apart.

    No text shuffles: the copies of most rows follow from source and bucket by a table of the sources, and those that are decided one by one
    (large ones, and one bucket a source) meet a list of them."""
    with shared.scratch():
        out, rule = _decide(docs, weights, share, max_epochs, seed)
        listed = shared.spill(out.where("listed").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_listed")), "listed", outlast=1)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), bucket_of(seed).alias("_bucket"), F.struct("*").alias("_row"))  # apart, whatever the columns are called
    small = lambda df: F.broadcast(df) if df.count() <= shared.FEW else df
    rows = rows.join(small(rule.withColumnsRenamed({c: f"_{c}_by" for c in rule.columns})), F.col("_source").eqNullSafe(F.col("_source_by")))
    rule_copies = F.least(F.col("_whole_by") + (F.col("_some_by") & (F.col("_bucket") <= F.col("_last_by"))).cast("long"), F.lit(int(max_epochs)))
    own = listed.withColumnRenamed("_id", "_at")
    if listed.count() <= shared.FEW:
        told = rows.join(F.broadcast(own), F.col("_id").eqNullSafe(F.col("_at")), "left")
    else:
        clear, some = shared.apart(rows, "_id", listed)
        told = clear.withColumns({"_at": F.lit(None).cast("long"), "_listed": F.lit(None).cast("long")}).unionByName(some.join(own, F.col("_id").eqNullSafe(F.col("_at")), "left"))
    told = told.select("_row", F.coalesce("_listed", rule_copies).alias("_copies")).where("_copies > 0")
    return told.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
