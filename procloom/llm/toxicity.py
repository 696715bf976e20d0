"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words (runs of letters, lower case) and their beginnings of some lengths, hashed; a text
has a term or not. The machine adds a bias, a weight for each term, and for each pair of terms the product
of their factors: that an insult next to the mention of a group is worse than both alone is a matter of the
pair, which no sum of weights expresses. It learns log loss by Adagrad from labelled rows.

Fitting takes at most max_rows rows of each label, chosen by a seeded hash of doc_id (bounded sample). A first machine learns a few rounds over all
terms of three texts or more, as what matters only beside another term shows by no count of its own. The machine that scores knows the terms with
the STRONGEST factors of the first, and those that tell the labels apart alone (chi-square); it would learn noise from the other thousands. The
first machine sees MAX_PAIRS pairs of a text and a term at most, by a share of the sample. Scoring takes every text whole, without a shuffle.

Texts: null and empty ones have no terms and get the bias alone. Labels that are null are left out; a row
that repeats trains or scores again. Without rows of both labels every score is the share of positives (0
without rows). Texts with the same terms tie, and a score of 0.5 counts as toxic. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared

BITS = 20
BEGINNINGS = (4, 5, 6, 8)
#: Terms that are taken over for their factors in the first machine, its rounds, and the pairs of a text and a term that it sees.
STRONGEST, ROUNDS, MAX_PAIRS = 64, 4, 1 << 24
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) pairs of lower-case texts, each once; only those terms where wanted holds."""
    starts, ends = shared.segments(data, offsets, _LETTER[data])
    of = np.searchsorted(offsets, starts, "right") - 1
    found = []
    for n in (0, *BEGINNINGS):
        some = np.flatnonzero(ends - starts > n)
        stop = ends[some] if not n else starts[some] + n
        term = ((shared.hashes(data, starts[some], stop) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        text = of[some]
        if wanted is not None:
            text, term = text[wanted[term]], term[wanted[term]]
        found.append(text << BITS | term)
    keys = np.unique(np.concatenate(found))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(b.schema.get_field_index("text"), "text", pc.utf8_lower(pc.fill_null(b.column("text"), "")))


@dataclass
class Machine:
    bias: float
    term: np.ndarray  # the terms that it knows, ascending
    weight: np.ndarray
    factors: np.ndarray

    def margin(self, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Margins of n texts from pairs of text number and position in term, ordered by text."""
        out = np.full(n, self.bias)
        if len(at):
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            v = self.factors[at]
            sums, squares = np.add.reduceat(v, first), np.add.reduceat(v * v, first)
            out[text[first]] += np.add.reduceat(self.weight[at], first) + 0.5 * (sums**2 - squares).sum(1)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        text, term = terms(data, offsets, wanted)
        return 1 / (1 + np.exp(-np.clip(self.margin(text, np.searchsorted(self.term, term), len(offsets) - 1), -30, 30)))


def telling(have: np.ndarray, toxic: np.ndarray, n: int, positives: int) -> np.ndarray:
    """Which terms tell the labels apart, by chi-square, given in how many texts and in how many positive ones each is: those that chance makes seem so once in 70 times or less."""
    expected = have * positives / n
    return (have >= 3) & ((toxic - expected) ** 2 > 6 * np.maximum(expected * (1 - positives / n), 1e-9))


def train(text: np.ndarray, term: np.ndarray, label: np.ndarray, rank: int = 6, epochs: int = 40, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Fit to labelled texts given as pairs of text number and term, ordered by text."""
    n, positives = len(label), int(label.sum())
    if not 0 < positives < n:
        share = min(max(positives / n, 1e-9), 1 - 1e-9) if n else 1e-9
        return Machine(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    known, at = np.unique(term, return_inverse=True)
    bounds = np.searchsorted(text, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(positives / (n - positives))), known, np.zeros(len(known)), rng.normal(0, 0.02, (len(known), rank)))
    seen_w, seen_v, seen_b = np.full(len(known), 1e-6), np.full((len(known), rank), 1e-6), 1e-6
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            pairs = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            which = np.repeat(np.arange(len(batch)), np.diff(bounds)[batch])
            a = at[pairs]
            slope = 1 / (1 + np.exp(-np.clip(m.margin(which, a, len(batch)), -30, 30))) - label[batch]
            m.bias -= rate * slope.sum() / np.sqrt(seen_b := seen_b + slope.sum() ** 2)
            v = m.factors[a]
            by_text = lambda x: np.stack([np.bincount(which, x[:, k], len(batch)) for k in range(rank)], 1)
            hit, spot = np.unique(a, return_inverse=True)  # only the terms of the batch are touched
            grad_w = np.bincount(spot, slope[which], len(hit)) + decay * m.weight[hit]
            part = slope[which][:, None] * (by_text(v)[which] - v)
            grad_v = np.stack([np.bincount(spot, part[:, k], len(hit)) for k in range(rank)], 1) + 10 * decay * m.factors[hit]
            seen_w[hit] += grad_w**2
            seen_v[hit] += grad_v**2
            m.weight[hit] -= rate * grad_w / np.sqrt(seen_w[hit])
            m.factors[hit] -= 0.3 * rate * grad_v / np.sqrt(seen_v[hit])
    return m


def strongest(text: np.ndarray, term: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The terms with the greatest factors in a machine that learns a few rounds over all terms."""
    m = train(text, term, label, epochs=ROUNDS)
    return m.term[np.argsort(-np.linalg.norm(m.factors, axis=1), kind="stable")[:STRONGEST]]


def learn(text: np.ndarray, term: np.ndarray, label: np.ndarray) -> Machine:
    """As fit, of pairs of text number and term, ordered by text."""
    have, toxic = (np.bincount(term, w, 1 << BITS) for w in (None, label[text]))
    often = have[term] >= 3
    wanted = telling(have.astype(float), toxic, max(len(label), 1), int(label.sum()))
    wanted[strongest(text[often], term[often], label)] = True
    keep = wanted[term]
    return train(text[keep], term[keep], label)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 6000, seed: int = 17) -> Machine:
    """A machine from the rows of docs that labels (doc_id, label 0 or 1) covers; at most max_rows of each label, chosen by hash."""
    shared.ship(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    chosen = shared.sample(usable.where("y = 1"), max_rows, seed).unionByName(shared.sample(usable.where("y = 0"), max_rows, seed))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * max_rows rows of 12 bytes at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in shared.passes(lowered(batches)):
            text, term = terms(data, offsets)
            cut = np.searchsorted(text, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], ["doc_id", "y", "terms"])

    def marked(told: DataFrame) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[told.select("term").toArrow().column("term").to_numpy()] = True  # 2 ** BITS terms at most
        return out

    def brought(sample: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term) pairs of the wanted terms, by doc_id, and labels."""

        def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                term, text = pc.list_flatten(b.column("terms")).to_numpy(), pc.list_parent_indices(b.column("terms")).to_numpy()
                keep = wanted[term]
                cut = np.searchsorted(text[keep], np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term[keep], pa.int32()))], ["doc_id", "y", "terms"])

        table = sample.mapInArrow(slim, "doc_id long, y int, terms array<int>").toArrow().combine_chunks().sort_by("doc_id")
        column = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        return np.repeat(np.arange(table.num_rows), np.asarray(pc.list_value_length(column))), np.asarray(pc.list_flatten(column)).astype(np.int64), np.asarray(table.column("y")).astype(float)

    with shared.scratch():
        sample = shared.spill(rows.select("doc_id", "text", "y").mapInArrow(read, "doc_id long, y int, terms array<int>"), "labelled")
        n, positives = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        each = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("have"), F.sum("y").alias("toxic")).where("have >= 3")
        each = shared.spill(each, "terms")
        expected = F.col("have") * positives / max(n, 1)
        wanted = marked(each.where((F.col("toxic") - expected) ** 2 > 6 * F.greatest(expected * (1 - positives / max(n, 1)), F.lit(1e-9))))
        pairs = each.agg(F.coalesce(F.sum("have"), F.lit(0))).first()[0]
        share = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 20)) < int(min(1.0, MAX_PAIRS / max(pairs, 1)) * (1 << 20))
        wanted[strongest(*brought(sample.where(share), marked(each)))] = True
        found = brought(sample, wanted)
    return train(*found)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of each row of docs."""
    spark = docs.sparkSession
    shared.ship(spark)
    model = spark.sparkContext.broadcast(machine)  # 2 ** BITS rows of a few numbers at most

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        wanted = np.zeros(1 << BITS, bool)
        wanted[m.term] = True
        for rows, data, offsets in shared.passes(lowered(batches)):
            s = m.scores(data, offsets, wanted)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double, predicted int")
