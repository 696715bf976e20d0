"""What several of the operators need: tables in the shared folder, and numpy kernels over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.tables import place, scratch, shared_folder, spill
from procloom.workers import ship

__all__ = ["place", "scratch", "shared_folder", "ship", "spill"]

#: Words of the contracts: runs of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers up to which a table is broadcast (some 32 MB as a hash table), and bits of a bitmap that is (16 MB as a table of its words).
FEW, MAX_BITS = 1_000_000, 1 << 26
#: Bytes of text that one numpy pass takes; a longer single text goes alone. Its arrays take some 60 times as much, and a worker keeps powers of 16 times as much.
PASS_BYTES = 1 << 19

_U = np.uint64
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows of df by a seeded hash of doc_id. Rows are thinned by their hash where they are read, so about 2 n rows meet for the choice however many df has."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    share = min(1.0, 2 * n / max(df.count(), 1))
    return df.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order, "doc_id").limit(n)


def picker(keys: DataFrame, key: str, max_bits: int = 1 << 28) -> tuple[Column, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """A column p of rows with a key, and what keeps the rows of batches with p whose key is in keys, and a few others. A bitmap over hashed keys (of max_bits / 8
    bytes at most) goes to every task, so that rows that no join will take don't shuffle."""
    bits = min(max_bits, max(1 << 12, 1 << (64 * keys.count()).bit_length()))
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(spot.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    wanted = keys.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            p = batch.column("p").to_numpy()
            yield batch.filter(pa.array((bitmap[p >> 6] >> (p & 63).astype(np.uint64)) & _U(1) > 0))

    return spot.alias("p"), keep


def apart(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key isn't among those of keys, rows whose key may be): a bitmap over hashed keys of MAX_BITS at most goes to the tasks as a table, and no row shuffles."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = spill(keys.select(spot.alias("_spot")).groupBy(F.expr("_spot div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_spot % 64 as int)))").alias("_mask")), "bitmap")
    told = rows.withColumn("_spot", spot).withColumn("_word", F.expr("_spot div 64")).join(F.broadcast(words), "_word", "left")
    maybe = F.coalesce(F.expr("shiftright(_mask, cast(_spot % 64 as int)) & 1 = 1"), F.lit(False))
    return told.where(~maybe).select(rows.columns), told.where(maybe).select(rows.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among those of ids, with their columns. Up to FEW ids go to every task; of more, only rows that a bitmap over them doesn't clear are joined."""
    ids = spill(ids.select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_row"))
    if ids.count() <= FEW:
        kept = rows.join(F.broadcast(ids), "_id", "left_anti")
    else:
        clear, maybe = apart(rows, "_id", ids)
        kept = clear.unionByName(maybe.join(ids, "_id", "left_anti"))
    return kept.select("_row.*")


def n_words(text: Column) -> Column:
    """Number of words as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def passes(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows with about PASS_BYTES of text: (rows, bytes of the texts, offsets). A null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(batch.column(text), "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PASS_BYTES, "right")) - 1)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """The first n powers or more of an odd base, and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, PASS_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
                _powers[k] = np.cumprod(np.r_[_U(1), np.full(n, base, np.uint64)])
    return _powers


def segments(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes where inside holds; a run never crosses from one text to the next."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: a polynomial over random byte values, from one running sum over data."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of each word of the texts; lower also folds A-Z."""
    starts, ends = segments(data, offsets, ~_SPACE[data])
    return hashes(_LOWER[data] if lower else data, starts, ends), starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbouring values: entry i covers i .. i + n - 1."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(values) - n + 1, _U(n) * _U(0xA24BAED4963EE407), np.uint64)
        for k in range(n):
            out = out * _BASE + values[k : k + len(out)]
        return mix(out)
