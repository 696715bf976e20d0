"""Ranked lexical search by three-phase uniform thresholds (TPUT; Cao and Wang, "Efficient top-K query calculation in distributed networks").

The index is a table of postings (term number, row, impact) that is dealt and sorted by term; the list of a frequent term spans
many partitions. Only terms of the items get lists; counts over the corpus are taken from all rows. Impacts are whole numbers,
and an item's list has them times the term's weight and its repeats in the item.

1. The k greatest impacts of each list are its head. Documents of an item's heads are scored in full, and the k-th greatest score, t, bounds the item's k-th
   score from below. (The sums over heads alone bound it, too, but at a fifth of it where an item has thirty lists.)
2. Of an item's m lists all entries of ceil(t / (SHARE * m)) or more are fetched. A document in none of them has less than t / SHARE. For the others the sum of
   what was fetched, and each other list's greatest entry below the threshold, bounds the score from above.
3. Documents whose upper bound is at least t are looked up in all of the item's lists, and the exact scores are ranked.

Heads and ranks are kept to k by list or item in each task before they meet. What is fetched is dealt by document before it meets the items, so that no
pair of an item and a document shuffles but for those that may rank, and no pair arises that shares no entry over the threshold.

Texts: null and empty ones have no terms; they are in no list and not among the counted documents. Texts of any length are read whole. Each row
is a document; rows that repeat a doc_id are ranked one by one, equal scores by doc_id (null last), then by row. Each row of the items is an item.
Items without terms, or without a document that scores, give no rows. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procloom.llm import shared

#: Postings that one task takes when entries meet the items.
TASK_POSTINGS = 1 << 19
#: Part of t that what isn't fetched may add up to. Impacts of a list differ little, so thresholds cut lists rather than entries: at 1 nearly as many
#: entries are fetched as at 4 (three quarters of all on the given tables), but thirty times as many documents may still rank.
SHARE = 4
#: Terms: runs of ASCII letters, digits and all other code points beyond ASCII. What else there is, as bytes, turns to a space, and A-Z to a-z.
_TERMS = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split(b" ")


def counted(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, term, tf): a row for each term of each row's text, and one with an empty term and tf 0; n is the text's number of terms. Rows without terms give none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in shared.passes(batches):
            whole = data.tobytes()
            found = [Counter(terms(whole[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            for c in found:
                c[b""] = 0
            n = np.fromiter((c.total() for c in found), np.int64, len(found))
            some = np.flatnonzero(n)
            sizes = np.fromiter((len(found[k]) for k in some.tolist()), np.int64, len(some))
            at = np.repeat(some, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).take(pa.array(at)), pa.array(n[at]), pa.array(chain.from_iterable(found[k] for k in some.tolist()), pa.binary()).cast(pa.string()),
                    pa.array(np.fromiter(chain.from_iterable(found[k].values() for k in some.tolist()), np.int64, len(at))),
                ],
                [key, "n", "term", "tf"],
            )

    return rows.select(key, "text").mapInArrow(count, f"{key} long, n long, term string, tf long")


def few(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to every task if the rows that it can have, most, are FEW at most."""
    return F.broadcast(df) if most <= shared.FEW else df


def nth(df: DataFrame, by: str, k: int, *order: F.Column) -> DataFrame:
    """The first k rows of each value of by, with their rank; each task keeps k by value before they meet."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    """postings: (t, row, impact), by term number; documents: (row, doc_id) of rows with terms; weights: (t, w); items: (item, item_id, t, repeats);
    and how many terms, items, lists of items and postings there are."""

    postings: DataFrame
    documents: DataFrame
    weights: DataFrame
    items: DataFrame
    n_terms: int
    n_items: int
    n_lists: int
    n_postings: int


def build(docs: DataFrame, items: DataFrame) -> Index:
    """The lists of all terms of items (item_id, text) over docs (doc_id, text)."""
    shared.ship(docs.sparkSession)
    named = shared.spill(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    asked = shared.spill(counted(named, "item").where("tf > 0").select("item", "term", F.col("tf").alias("repeats")), "asked")
    numbers = asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id() + 1)
    numbers = numbers.unionByName(docs.sparkSession.createDataFrame([("", 0)], "term string, t long"))  # number 0 tells of documents
    numbers = shared.spill(numbers, "terms")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ids = shared.spill(rows.select("row", "doc_id"), "rows")
    raw = shared.spill(counted(rows, "row").join(few(numbers, numbers.count()), "term").select("t", "row", "n", "tf"), "counts")
    n_docs, n_terms = raw.where("t = 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = 75 + F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)").alias("impact")
    postings = raw.where("t > 0").withColumn("m", m).select("t", "row", impact)
    postings = shared.spill(postings.repartitionByRange("t", "row").sortWithinPartitions("t", "row"), "postings")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = shared.spill(postings.groupBy("t").agg(F.count("*").alias("df")).select("t", weight).where("w > 0"), "weights")
    n_numbers, n_items = numbers.count(), named.count()
    lists = asked.join(few(numbers, n_numbers), "term").join(few(named.select("item", "item_id"), n_items), "item").select("item", "item_id", "t", "repeats")
    return Index(postings, ids, weights, lists, n_numbers, n_items, asked.count(), postings.count())


def exact(index: Index, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, row, score) of pairs (item, row), looked up in all of the item's lists."""
    pairs = shared.spill(pairs, "pairs")
    rows = pairs.select("row").distinct()
    entries = index.postings.join(few(rows, pairs.count()), "row", "left_semi")
    asked = pairs.join(few(lists.select("item", "t", "w"), index.n_lists), "item")
    return entries.join(asked, ["t", "row"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")


def top(index: Index, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k documents with the highest scores above 0."""
    postings, n_terms, n_items, n_lists = index.postings, index.n_terms, index.n_items, index.n_lists
    lists = shared.spill(index.items.join(few(index.weights, n_terms), "t").select("item", "item_id", "t", (F.col("w") * F.col("repeats")).alias("w")), "weighted")

    heads = shared.spill(nth(postings, "t", k, F.desc("impact"), F.asc("row")), "heads")
    met = few(lists, n_lists).join(heads, "t").select("item", "row").distinct()
    bound = nth(exact(index, lists, met), "item", k, F.desc("score")).where(F.col("rank") == k).select("item", F.col("score").alias("bound"))
    first = heads.where("rank = 1").select("t", F.col("impact").alias("most"))
    m = lists.groupBy("item").agg(F.count("*").alias("m")).join(few(bound, n_items), "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    m = m.withColumn("least", F.greatest(F.lit(1), F.expr(f"(bound + {SHARE} * m - 1) div ({SHARE} * m)")))
    told = lists.join(few(first, n_terms), "t").join(few(m.drop("m"), n_items), "item").withColumn("cap", F.least(F.col("w") * F.col("most"), F.col("least") - 1))
    told = shared.spill(told, "thresholds")

    need = told.groupBy("t").agg(F.min(F.expr("(least + w - 1) div w")).alias("need"))
    strong = postings.join(few(need, n_terms), "t").where("impact >= need").select("t", "row", "impact")
    strong = strong.repartition(1 + index.n_postings // TASK_POSTINGS, "row")  # the sums of a document's items are then in one task
    entry = strong.join(few(told.select("item", "t", "w", "least", "cap"), n_lists), "t").where("w * impact >= least")
    sums = entry.groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact") - F.col("cap")).alias("over"))
    rest = told.groupBy("item").agg(F.sum("cap").alias("caps"), F.max("bound").alias("bound"))
    able = sums.join(few(rest, n_items), "item").where("over + caps >= bound").select("item", "row")

    ranked = nth(exact(index, lists, able).join(index.documents, "row"), "item", k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    return ranked.join(few(index.items.select("item", "item_id").distinct(), n_items), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) the k documents of docs (doc_id, text) with the highest scores above 0."""
    with shared.scratch():
        return shared.spill(top(build(docs, items), k), "ranked", outlast=1)
