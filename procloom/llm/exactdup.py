"""Exact deduplication in two passes with a Bloom filter.

Pass one marks k positions for each text's SHA-256. Every task combines its own marks and sends, by slice of the
filter, positions or, where they take less room, two bitmaps (set, and set again); a slice's own pass adds them up and
keeps the bits that were set twice or more. A hash all of whose bits are such is possibly repeated. In pass two only
possibly repeated rows shuffle, to be grouped by their full hash; all others pass straight through as groups of one.
False positives only cost a shuffle of a few slim rows; the groups themselves are exact.

The filter has 16 bits a row or more at any number of rows: beyond what max_bits allows (max_bits / 8 bytes are
broadcast), the passes are run by range of the hash, one range after the other.

Texts: of any length they are hashed whole. Null counts as empty, and empty texts are equal to each other. Of equal texts the row with the
largest doc_id stays; rows that repeat a doc_id count once each. Only doc_id and text are read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared

SLICE_BITS = 1 << 20
HASHES = 2
ROW_BITS = 16
#: Positions that a task combines at a time.
COMBINED = 1 << 22


def positions(sha: pa.Array, bits: int) -> np.ndarray:
    """HASHES bit positions (columns) of each hex SHA-256; bits is a power of two."""
    raw = np.frombuffer("".join(sha.to_pylist()).encode(), np.uint8).reshape(-1, 64)
    nibble = np.where(raw < 58, raw - 48, raw - 87).astype(np.uint64)
    out = np.zeros((len(raw), HASHES), np.uint64)
    for k in range(HASHES):
        for j in range(16):
            out[:, k] = out[:, k] << np.uint64(4) | nibble[:, 16 * k + j]
    return (out & np.uint64(bits - 1)).astype(np.int64)


def twice(at: np.ndarray, size: int) -> np.ndarray:
    """0, 1 or 2 (for more) by position."""
    return np.minimum(np.bincount(at, minlength=size), 2).astype(np.uint8)


def repeated_bits(hashed: DataFrame, bits: int) -> DataFrame:
    """(slice, bitmap of the bits that were set twice or more), for slices that have any."""
    size = min(bits, SLICE_BITS)

    def combined(at: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, times = np.unique(at, return_counts=True)
        cut = np.flatnonzero(np.diff(at // size)) + 1
        for part, n in zip(np.split(at, cut), np.split(times, cut)) if len(at) else ():
            spot = (part % size).astype(np.uint32)
            marks, dense = np.r_[spot, spot[n > 1]].tobytes(), False
            if len(marks) > size // 4:
                once, again = np.zeros(size, bool), np.zeros(size, bool)
                once[spot], again[spot[n > 1]] = True, True
                marks, dense = np.packbits(np.r_[once, again]).tobytes(), True
            yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) // size]), pa.array([dense]), pa.array([marks], pa.binary())], ["slice", "dense", "marks"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(positions(batch.column("text_sha256"), bits).ravel())
            n += len(held[-1])
            if n >= COMBINED:
                yield from combined(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from combined(np.concatenate(held))

    def times(marks: bytes, dense: bool) -> np.ndarray:
        if dense:
            return np.unpackbits(np.frombuffer(marks, np.uint8)).reshape(2, size).sum(0, dtype=np.uint8)
        return twice(np.frombuffer(marks, np.uint32), size)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(size, np.uint8)

        def row() -> Iterator[pa.RecordBatch]:
            if key is not None and (total > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], ["slice", "bitmap"])

        for batch in batches:
            for k, d, m in zip(batch.column("slice").to_pylist(), batch.column("dense").to_pylist(), batch.column("marks")):
                if k != key:
                    yield from row()
                    key, total = k, np.zeros(size, np.uint8)
                total = np.minimum(total + times(m.as_py(), d), 2)
        yield from row()

    # each slice is one key; its rows stream through in order, so a task holds one slice at a time
    return hashed.select("text_sha256").mapInArrow(marks, "slice long, dense boolean, marks binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(merged, "slice long, bitmap binary")


def possibly_repeated(hashed: DataFrame, bits: int) -> DataFrame:
    """The rows of hashed (doc_id, text_sha256) with again: false where the filter of so many bits tells that no other row has the hash."""
    spark = hashed.sparkSession
    size = min(bits, SLICE_BITS)
    found = {r["slice"]: bytes(r["bitmap"]) for r in repeated_bits(hashed, bits).collect()}  # bits / 8 bytes at most
    shared_bits = spark.sparkContext.broadcast(found)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for k, b in shared_bits.value.items():
            bitmap[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(b, np.uint8)
        for batch in batches:
            at = positions(batch.column("text_sha256"), bits)
            again = ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again)], ["doc_id", "text_sha256", "again"])

    out = shared.spill(hashed.mapInArrow(marked, "doc_id long, text_sha256 string, again boolean"), "marked", outlast=1)
    shared_bits.unpersist()
    return out


def exact_groups(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs. max_bits: a power of two from 64 on that bounds the filter of a pass (2**28: 32 MB)."""
    shared.ship(docs.sparkSession)
    with shared.scratch():
        hashed = shared.spill(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), "hashes")
        need = max(1 << 12, 1 << (ROW_BITS * hashed.count()).bit_length())
        ranges = min(max(1, need // max_bits), 1 << 16)
        if ranges == 1:
            seen = possibly_repeated(hashed, need)
        else:
            at = F.pmod(F.conv(F.substring("text_sha256", 1, 4), 16, 10).cast("int"), F.lit(ranges))
            dealt = shared.spill(hashed.withColumn("range", at), "dealt", by="range")
            parts = [possibly_repeated(dealt.where(F.col("range") == k).drop("range"), max_bits) for k in range(ranges)]
            seen = reduce(DataFrame.unionByName, parts)
        again = seen.where("again").drop("again")
        groups = again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
        groups = shared.spill(groups, "groups", outlast=1)  # apart from the join, whose rows of a large group can then be split over tasks
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = F.col("group_size").isNull()
    grouped = (
        again.join(groups, "text_sha256", "left")
        .withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )
    single = seen.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.select(out).unionByName(grouped.select(out))


def drop_exact(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of docs without the copies, with their columns. doc_id must tell rows apart: rows of a dropped doc_id go. Rows that can't be dropped don't shuffle."""
    with shared.scratch():
        dropped = shared.spill(exact_groups(docs, max_bits).where("not kept").select("doc_id"), "copies", outlast=1)
    return shared.without(docs, dropped)
