"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

A document's pieces of full length are sequences of their own. The others are dealt into blocks of about
block_items pieces by a hash, so no block depends on a key's frequency. Each block is evolved on several
islands: an individual is an assignment of pieces to bins; crossover injects whole well-filled bins of one
parent into the other, drops the bins that hold the same pieces twice, lets displaced pieces take the place of
smaller ones that fill a bin worse, and best-fits the rest, largest first. Only the first island starts from best fit
by length; the others start from disturbed orders. As most bins are full from the start, each island then searches
among cores: its badly filled bins with some others. After each epoch every island's elite moves to the next
island of its block. The best of a block's islands counts; pieces of bins that are not well filled go on to the
next, smaller level, until one block holds all that is left, or a level fills hardly any bin well, as then
nothing that is left fits better elsewhere.

Texts: null and empty give the end token alone. Any length is taken whole. Rows that repeat are packed once
each. Pieces of equal length are told apart by the row they came in; of equal assignments the first island's counts.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared
from procloom.llm.tokencount import byte_symbols


class Encoder:
    """Ids of a byte-level vocabulary given as tokenizers json, by tiktoken, whose merging gives the same ids about five times as fast."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.path = path
        self.slow = None
        # Fixed value: the splitting pattern of byte-level pre-tokenizers.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # its pattern engine gives up on some texts, such as very long white space, by a panic
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a unique item of each piece. Documents over size tokens are cut into pieces of size, the first of them shorter."""
    shared.ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, item = encoder(vocabulary), TaskContext.get().partitionId() << 33
        for rows, _, _ in shared.passes(batches):
            out = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").fill_null("").to_pylist()):
                ids = np.append(e.ids(text).astype("<u4"), np.array([end], "<u4"))
                edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), item))
                    item += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(zip(*out))], ["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, item long")


@dataclass(frozen=True)
class Evolution:
    """Sizes of the search. A bin is well filled from well_filled of its size on; a core has core_items pieces and is searched by a population of its own."""

    block_items: int = 8192
    islands: int = 3
    epochs: int = 2
    population: int = 3
    generations: int = 2
    well_filled: float = 0.995
    cores: int = 2
    core_items: int = 240
    core_population: int = 6
    core_generations: int = 6


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, fill: np.ndarray, size: int) -> np.ndarray:
    """Put the items of order, in turn, where they leave least room; bins (by item) is filled in; the fills of all bins."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0
    fills = fill.tolist()
    for b in np.flatnonzero((fill > 0) & (fill < size)).tolist():
        room[size - fills[b]].append(b)
        open_rooms |= 1 << (size - fills[b])
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = size, len(fills)
            fills.append(0)
        bins[i] = b
        fills[b] += n
        if r > n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return np.array(fills, np.int64)


#: Pieces up to which a crossover also tries swaps, as in cores.
SWAPS_UP_TO = 1024


def fitness(lengths: np.ndarray, bins: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first; of as many, uneven fills are better, as they leave room for more."""
    fill = np.bincount(bins, lengths)
    return -int((fill > 0).sum()), float(((fill / size) ** 2).sum())


def swapped(lengths: np.ndarray, bins: np.ndarray, loose: np.ndarray, size: int) -> np.ndarray:
    """Let loose pieces, largest first, take the place of one or two smaller ones of a bin that is fuller then (one change a bin); what is loose afterwards."""
    placed = np.setdiff1d(np.arange(len(lengths)), loose)
    if not len(placed) or not len(loose):
        return loose
    placed = placed[np.argsort(bins[placed], kind="stable")]
    at = bins[placed]
    one = np.arange(len(placed))
    left, right = [one], [one]
    for gap in range(1, int(np.bincount(at).max())):  # pairs in one bin stand within so many places
        same = one[:-gap][at[:-gap] == at[gap:]]
        left.append(same)
        right.append(same + gap)
    u, v = np.concatenate(left), np.concatenate(right)
    weight = lengths[placed[u]] + np.where(u == v, 0, lengths[placed[v]])
    where = at[u]
    room = size - np.bincount(at, lengths[placed]).astype(np.int64)[where]
    rest = []
    for i in loose[np.argsort(-lengths[loose], kind="stable")].tolist():
        gain = lengths[i] - weight
        gain = np.where((gain > 0) & (gain <= room), gain, 0)
        k = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or not gain[k]:
            rest.append(i)
            continue
        rest += {int(placed[u[k]]), int(placed[v[k]])}
        bins[i] = where[k]
        room[where == where[k]] = -1
    return np.array(rest, np.int64)


def crossover(lengths: np.ndarray, first: np.ndarray, second: np.ndarray, size: int, well: float, rng: np.random.Generator) -> np.ndarray:
    """first with about half of the well-filled bins of second injected whole."""
    chosen = (np.bincount(second, lengths) >= well * size) & (rng.random(second.max() + 1) < 0.5)
    injected = chosen[second]
    fill = np.bincount(first, lengths)
    broken = (fill > 0) & (fill < well * size) & (rng.random(len(fill)) < 0.5)  # badly filled bins are opened as well
    broken[first[injected]] = True
    displaced = broken[first] & ~injected
    child = first.copy()
    child[injected] = second[injected] + first.max() + 1
    child[displaced] = 0
    stay = ~displaced
    labels, child[stay] = np.unique(child[stay], return_inverse=True)
    loose = np.flatnonzero(displaced)
    if len(lengths) <= SWAPS_UP_TO:
        loose = swapped(lengths, child, loose, size)
        stay = np.ones(len(lengths), bool)
        stay[loose] = False
    fill = np.bincount(child[stay], lengths[stay], len(labels)).astype(np.int64)
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], child, fill, size)
    return child


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], size: int, how: Evolution, rng: np.random.Generator, population: int, generations: int, plain: bool) -> np.ndarray:
    """The best assignment after some generations from the given elites and disturbed starts; plain: one start is best fit by length."""
    people = list(seeds)
    while len(people) < population:
        bins = np.zeros(len(lengths), np.int64)
        noise = 0 if plain and not people else rng.normal(0, 0.02 * size, len(lengths))
        best_fit(lengths, np.argsort(-(lengths + noise), kind="stable"), bins, np.zeros(0, np.int64), size)
        people.append(bins)
    rank = lambda b: fitness(lengths, b, size)
    people.sort(key=rank, reverse=True)
    least = -(-int(lengths.sum()) // size)
    for _ in range(generations):
        if -rank(people[0])[0] <= least:
            break
        children = []
        for k in range(population):
            a, b = rng.choice(len(people), 2, replace=False)
            children.append(crossover(lengths, people[min(a, b)], people[max(a, b)], size, how.well_filled, rng))
        people = sorted(people + children, key=rank, reverse=True)[:population]
    return people[0]


def search(lengths: np.ndarray, seeds: list[np.ndarray], size: int, how: Evolution, rng: np.random.Generator, plain: bool = True) -> np.ndarray:
    """An island's epoch: the whole block for some generations, then cores of badly filled bins and others."""
    bins = evolve(lengths, seeds, size, how, rng, how.population, how.generations, plain)
    for _ in range(how.cores):
        fill = np.bincount(bins, lengths)
        used = np.flatnonzero(fill)
        if len(used) <= -(-int(lengths.sum()) // size):
            break
        turn = used[np.lexsort([rng.random(len(used)), np.where(fill[used] < how.well_filled * size, 0, 1)])]
        many = np.cumsum(np.bincount(bins)[turn])
        core = np.flatnonzero(np.isin(bins, turn[: max(2, int(np.searchsorted(many, how.core_items)))]))
        own = np.unique(bins[core], return_inverse=True)[1]
        better = evolve(lengths[core], [own], size, how, rng, how.core_population, how.core_generations, False)
        if fitness(lengths[core], better, size) > fitness(lengths[core], own, size):
            bins = bins.copy()
            bins[core] = better + bins.max() + 1
            bins = np.unique(bins, return_inverse=True)[1]
    return bins


def pack_level(items: DataFrame, blocks: int, level: int, size: int, how: Evolution, seed: int) -> DataFrame:
    """item, length, block, bin, offset, fill of items dealt into blocks."""
    dealt = items.select("item", "length", F.pmod(F.xxhash64(F.lit(seed + level), "item"), F.lit(blocks)).alias("block"))
    spread = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))))
    elites = spread.withColumn("own", F.lit(None).cast("long")).withColumn("guest", F.lit(None).cast("long"))

    def epoch_of(epoch: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def live(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item", ignore_index=True)
            lengths = pdf["length"].to_numpy()
            seeds = [pdf[c].to_numpy(np.int64) for c in ("own", "guest") if not pdf[c].isna().any()]
            bins = search(lengths, seeds, size, how, np.random.default_rng([seed, level, epoch, *map(int, key)]), plain=int(key[1]) == 0)
            count, square = fitness(lengths, bins, size)
            return pdf[["item", "length", "block", "island"]].assign(bin=bins, bins=-count, square=square)

        return live

    for epoch in range(how.epochs):
        lived = elites.groupBy("block", "island").applyInPandas(epoch_of(epoch), "item long, length long, block long, island int, bin long, bins long, square double")
        if epoch + 1 < how.epochs:  # each island's elite goes to the next island as a guest
            lived = shared.spill(lived, "elites")
            guest = lived.select("item", F.pmod(F.col("island") + 1, F.lit(how.islands)).alias("island"), F.col("bin").alias("guest"))
            elites = lived.select("item", "length", "block", "island", F.col("bin").alias("own")).join(guest, ["item", "island"])

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["bins", "square", "island"], ascending=[True, False, True])["island"].iloc[0]
        out = pdf[pdf["island"] == best].sort_values(["bin", "item"])
        by = out.groupby("bin")["length"]
        return out.assign(offset=by.cumsum() - out["length"], fill=by.transform("sum"))[["item", "length", "block", "bin", "offset", "fill"]]

    return lived.groupBy("block").applyInPandas(settle, "item long, length long, block long, bin long, offset long, fill long")


def pack(cut: DataFrame, size: int = 1024, how: Evolution = Evolution(), seed: int = 5) -> DataFrame:
    """sequence_id and offset for each row of cut (a result of pieces())."""
    with shared.scratch():
        cut = shared.spill(cut, "pieces", outlast=1)
        placed = [cut.where(F.col("length") == size).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
        left = cut.where(F.col("length") < size).select("item", "length")
        n, level = left.count(), 0
        while n:
            blocks = -(-n // how.block_items)
            done = shared.spill(pack_level(left, blocks, level, size, how, seed), "packed", outlast=1)
            final = F.lit(blocks == 1) | (F.col("fill") >= how.well_filled * size)
            base = F.lit(level).cast("long") * (1 << 56) + F.col("block") * (1 << 20) + F.col("bin")
            placed.append(done.where(final).select("item", base.alias("sequence_id"), "offset"))
            left = done.where(~final).select("item", "length")
            before, n, level = n, left.count(), level + 1
            if n > 0.9 * before:  # hardly anything fits better: take what there is
                placed.append(done.where(~final).select("item", base.alias("sequence_id"), "offset"))
                break
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return cut.join(where, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
