"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

A run is a stretch of words with smallest period q, of max(least, times * q) words or more, that no neighbouring word
extends with that period kept. Words get exact names a text (a dictionary, no hashes), and windows of 2, 4, 8, ... words
are named by sorting the pairs of names of their halves; a window that no other equals gets none and is never sorted again.
The length to which two places agree is read off the levels from the widest window down, for all pairs at once.

A run of period q holds step = max(least - q, (times - 1) * q) neighbouring places that equal the place q later, so one of
them is a multiple of step: these are the candidates, n * log(n) / (times - 1) of a text of n words. Those whose two words
are the same are extended to both sides. A run found by a multiple of its period has the same ends, and the smallest stays.

Many texts are named together: names of one text are in no other, so no window that passes a text's end equals another.
A text beyond PASS_BYTES goes alone; its names take 4 bytes a word and level.

Texts: null and empty ones have no words and no runs. Texts of any length are read whole. Rows that repeat get the same
result each. Other columns pass along unread. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared

#: Candidates that are looked at together.
BLOCK = 1 << 21
RUNS = "array<struct<start: long, length: long, period: long>>"


class _Names(dict):
    """Numbers of words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def levels(first: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words from each place (and one place past the end): equal for equal windows, -1 where no other window is equal."""

    def named(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        _, name, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[name] > 1
        out = np.full(len(first) + 1, -1, np.int32)
        out[at[again]] = name[again]
        return out

    out = [named(np.arange(len(first)), first)]
    while (out[-1] >= 0).any():
        last, half = out[-1], 1 << (len(out) - 1)
        at = np.flatnonzero((last[:-half] >= 0) & (last[half:] >= 0)) if half < len(last) else np.zeros(0, np.int64)
        out.append(named(at, last[at].astype(np.int64) << 32 | last[at + half]))
    return out[:-1]


def agreed(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """To how many words the places i and j (later) agree before them and from them on."""
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        a = names[k][i + ahead]
        ahead += np.where((a >= 0) & (a == names[k][j + ahead]), width, 0)
        at = i - behind - width
        b = names[k][np.maximum(at, 0)]
        behind += np.where((at >= 0) & (b >= 0) & (b == names[k][np.maximum(at, 0) + j - i]), width, 0)
    return behind, ahead


def find_runs(first: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) of all runs, by start and period, of texts of so many words each whose word names stand one behind the other in first."""
    names = levels(first)
    if not names:
        return np.zeros((0, 3), np.int64)
    begins = np.cumsum(sizes) - sizes
    n_periods = np.where(sizes >= least, sizes // times, 0)
    text = np.repeat(np.arange(len(sizes)), n_periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(n_periods) - n_periods, n_periods) + 1
    step = np.maximum(least - period, (times - 1) * period)
    points = -(-(sizes[text] - period) // step)
    total = np.cumsum(points)
    found = []
    lo = 0
    while lo < len(text):  # by blocks of (text, period)
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - points[lo] + BLOCK, "right")))
        n = points[lo:hi]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(period[lo:hi], n)
        i = np.repeat(begins[text[lo:hi]], n) + nth * np.repeat(step[lo:hi], n)
        word = names[0][i]
        same = (word >= 0) & (word == names[0][i + q])
        i, q = i[same], q[same]
        behind, ahead = agreed(names, i, i + q)
        run = np.stack([i - behind, behind + ahead + q, q], 1)
        found.append(np.unique(run[run[:, 1] >= np.maximum(least, times * q)], axis=0))
        lo = hi
    runs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    smallest = np.ones(len(runs), bool)  # equal ends stand together, the smallest period first
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period), collapsed (the words but for those that
    some run holds after its first period, joined by a space) of each row of docs."""
    shared.ship(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in shared.passes(batches):
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]  # bytes split at the six ASCII blanks
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            first, base = np.zeros(int(sizes.sum()), np.int64), 0
            ends = np.cumsum(sizes)
            for ws, end in zip(words, ends.tolist()):
                names = _Names()
                first[end - len(ws) : end] = np.fromiter(map(names.__getitem__, ws), np.int64, len(ws)) + base
                base += len(names)
            runs = find_runs(first, sizes, least, times)
            begins = ends - sizes
            of = np.searchsorted(ends, runs[:, 0], "right")
            change = np.zeros(len(first) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change)[:-1] == 0
            some = np.zeros(len(words), bool)
            some[of] = True
            text = [b" ".join(compress(ws, kept[end - len(ws) : end].tolist()) if s else ws) for ws, end, s in zip(words, ends.tolist(), some.tolist())]
            parts = [pa.array(c) for c in (runs[:, 0] - begins[of], runs[:, 1], runs[:, 2])]
            cut = np.r_[0, np.cumsum(np.bincount(of, minlength=len(words)))].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(sizes), column, pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a period planted in one document of ten, told by the id: each word from place a on becomes that at a + (i - a) % p."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shared.WORD), F.lit(0))
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    head, period = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    drawn = F.array_join(F.concat(head, tail), " ")
    return F.when((h % 10 == 0) & (n > 0), drawn).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The columns of op12 from those of periodic_runs."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
