"""Greedy packing of ordered units into batches and packets under limits.

Packing in order is sequential by nature: a batch starts where the one before it ended. Units are therefore sorted
over the cluster and cut into segments by position. Each segment is summed up by what it does to any open batch that
comes in: where the batch breaks, and what every possible break leads to. Only the units up to the first that no open
batch takes can be a break, so a summary is as short as one batch, however long the segment. Runs of FAN summaries
compose into one of the same kind, as a tree; going back down, each segment learns what comes in and numbers its own
batches. So a group of any size spreads over the cluster, while the result is that of one pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procloom import workers
from procloom.functions import columns as C
from procloom.operators.joins import null_safe
from procloom.operators.splitting import MAX_BLOCKS, MAX_CHARS, split_blocks
from procloom.tables import scratch, spill

#: Units in a segment, and summaries that one task composes.
SEGMENT, FAN = 50_000, 64
#: So many blocks and more mean no limit of blocks.
NO_LIMIT = 1 << 30


@dataclass(frozen=True)
class Limits:
    blocks: int
    chars: int

    def alone(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (b > self.blocks) | (c > self.chars)


@dataclass
class Summary:
    """What a run of units does to an open batch. Entry i is a unit that may break it: b and c are the sums of blocks and chars up to it, and a break
    there leaves (eb, ec) open and starts n batches in the run. sure: the last entry breaks any batch. blocks, chars: sums of the whole run.
    Entry 0 is for a run that starts without an open batch."""

    b: np.ndarray
    c: np.ndarray
    eb: np.ndarray
    ec: np.ndarray
    n: np.ndarray
    sure: bool
    blocks: int
    chars: int

    def after(self, blocks: np.ndarray, chars: np.ndarray, count: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Open (blocks, chars) and batches so far, behind the run, for those before it; blocks of 0: no batch is open."""
        i = 1 + np.minimum(np.searchsorted(self.b[1:], limits.blocks - blocks, "right"), np.searchsorted(self.c[1:], limits.chars - chars, "right"))
        if self.sure:
            i = np.minimum(i, len(self.b) - 1)
        i = np.where(blocks == 0, 0, i)
        hit = i < len(self.b)
        i = np.minimum(i, len(self.b) - 1)
        return np.where(hit, self.eb[i], blocks + self.blocks), np.where(hit, self.ec[i], chars + self.chars), count + np.where(hit, self.n[i], 0)

    def row(self) -> dict[str, object]:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}


SUMMARY = "b array<long>, c array<long>, eb array<long>, ec array<long>, n array<long>, sure boolean, blocks long, chars long"


def _summaries(pdf: pd.DataFrame) -> list[Summary]:
    arrays = ("b", "c", "eb", "ec", "n")
    return [Summary(*(np.asarray(getattr(r, k), np.int64) for k in arrays), bool(r.sure), int(r.blocks), int(r.chars)) for r in pdf.itertuples()]


def _next(blocks: np.ndarray, chars: np.ndarray, limits: Limits, first: np.ndarray | None = None) -> np.ndarray:
    """For a batch that starts at each unit, the unit where the next starts; units where first holds begin a group."""
    n, alone = len(blocks), limits.alone(blocks, chars)
    b, c = np.r_[0, np.cumsum(blocks)], np.r_[0, np.cumsum(chars)]
    to = np.minimum(np.searchsorted(b, b[:-1] + limits.blocks, "right"), np.searchsorted(c, c[:-1] + limits.chars, "right")) - 1
    stop = np.append(np.flatnonzero(alone), n)  # a unit that stands alone also ends the batch before it
    to = np.where(alone, np.arange(n) + 1, np.minimum(to, stop[np.searchsorted(stop, np.arange(n))]))
    if first is None:
        return to
    stop = np.append(np.flatnonzero(first), n)
    return np.minimum(to, stop[np.searchsorted(stop, np.arange(n), "right")])


def _breaks(blocks: np.ndarray, chars: np.ndarray, limits: Limits) -> tuple[np.ndarray, list[np.ndarray]]:
    """_next, and (exit blocks, exit chars, batches) from a batch that starts at each unit to the end."""
    n, alone = len(blocks), limits.alone(blocks, chars)
    b, c, to = np.r_[0, np.cumsum(blocks)], np.r_[0, np.cumsum(chars)], _next(blocks, chars, limits)
    exit_b, exit_c, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    ends = to == n
    exit_b[:-1], exit_c[:-1] = np.where(ends & ~alone, b[n] - b[:-1], 0), np.where(ends & ~alone, c[n] - c[:-1], 0)
    for i in range(n - 1, -1, -1):
        if not ends[i]:
            exit_b[i], exit_c[i] = exit_b[to[i]], exit_c[to[i]]
        count[i] = 1 + count[to[i]]
    return to, [exit_b, exit_c, count]


def summarise(blocks: np.ndarray, chars: np.ndarray, limits: Limits) -> Summary:
    _, (eb, ec, n) = _breaks(blocks, chars, limits)
    b, c, alone = np.cumsum(blocks), np.cumsum(chars), limits.alone(blocks, chars)
    never = np.flatnonzero(alone | (b >= limits.blocks) | (c > limits.chars))  # an open batch has a block
    k = int(never[0]) + 1 if len(never) else len(blocks)
    keep = np.arange(k)
    if limits.blocks >= NO_LIMIT:
        keep = keep[(chars[:k] > 0) | alone[:k]]  # what weighs nothing breaks nothing
    keep = np.r_[0, keep]
    return Summary(b[keep], c[keep], eb[keep], ec[keep], n[keep], bool(len(never)), int(b[-1]), int(c[-1]))


def compose(parts: list[Summary], limits: Limits) -> Summary:
    """The summary of runs that follow each other."""
    found: list[list[np.ndarray]] = []
    blocks = chars = 0
    sure = False
    for k, part in enumerate(parts):
        first = 0 if not k else 1  # entry 0 of the first run only
        state = part.eb[first:], part.ec[first:], part.n[first:]
        for later in parts[k + 1 :]:
            state = later.after(*state, limits)
        found.append([part.b[first:] + blocks, part.c[first:] + chars, *state])
        blocks, chars, sure = blocks + part.blocks, chars + part.chars, part.sure
        if sure or blocks >= limits.blocks or chars > limits.chars:
            break
    b, c, eb, ec, n = (np.concatenate(x) for x in zip(*found))
    if not sure:  # later runs break any batch that gets so far
        sure = bool(len(b) > 1 and (b[-1] >= limits.blocks or c[-1] > limits.chars))
    return Summary(b, c, eb, ec, n, sure, sum(p.blocks for p in parts), sum(p.chars for p in parts))


def greedy(units: DataFrame, max_blocks: int = MAX_BLOCKS, max_chars: int = MAX_CHARS, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """grp, ord, batch_no (from 0 in each group) of units (grp string, ord long, unique in its group; blocks long from 1 on; chars long).

    A unit over a limit stands alone. A negative ord is allowed; null groups are one group. With a column sub (long), units are in order of ord, then sub, and sub is given, too."""
    workers.ship(units.sparkSession)
    limits = Limits(max_blocks, max_chars)
    order = ["ord", "sub"] if "sub" in units.columns else ["ord"]
    orders = ", ".join(f"{c} long" for c in order)

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """A segment's units in order, as the cluster sorts them, and where its groups start and the last ends."""
        pdf = pdf.sort_values(["grp", *order], ignore_index=True, na_position="first")
        codes, _ = pd.factorize(pdf["grp"], use_na_sentinel=False)
        return pdf, np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(pdf)]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the first group and the last only: those between lie in this segment whole."""
        pdf, at = ordered(pdf)
        rows = []
        for lo, hi in sorted({(at[0], at[1]), (at[-2], at[-1])}):
            part = pdf.iloc[lo:hi]
            rows.append({"grp": part["grp"].iloc[0], "seg": part["seg"].iloc[0]} | summarise(part["blocks"].to_numpy(np.int64), part["chars"].to_numpy(np.int64), limits).row())
        return pd.DataFrame(rows)

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        return pd.DataFrame([{"grp": pdf["grp"].iloc[0], "seg": pdf["seg"].iloc[0] // fan} | compose(_summaries(pdf), limits).row()])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        state, rows = tuple(pdf[["in_blocks", "in_chars", "in_count"]].to_numpy(np.int64)[:1].T), []
        for seg, part in zip(pdf["seg"], _summaries(pdf)):
            rows.append((pdf["grp"].iloc[0], seg, *(int(x[0]) for x in state)))
            state = part.after(*state, limits)
        return pd.DataFrame(rows, columns=["grp", "seg", "in_blocks", "in_chars", "in_count"])

    def number(pdf: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        """All groups of a segment in one go; only the first may come with an open batch."""
        pdf, at = ordered(pdf)
        b, c = pdf["blocks"].to_numpy(np.int64), pdf["chars"].to_numpy(np.int64)
        fresh = np.zeros(len(b), bool)
        fresh[at[:-1]] = True
        to = _next(b, c, limits, fresh).tolist()
        grp = pdf["grp"].iloc[0]
        own = come[come["grp"].isna()] if pd.isna(grp) else come[come["grp"] == grp]
        blocks, chars, base = (int(own[x].iloc[0]) for x in ("in_blocks", "in_chars", "in_count"))
        start = np.zeros(len(b), np.int64)
        end = at[1]
        bad = np.flatnonzero((blocks + np.cumsum(b[:end]) > max_blocks) | (chars + np.cumsum(c[:end]) > max_chars) | limits.alone(b[:end], c[:end]))
        i = 0 if not blocks else int(bad[0]) if len(bad) else int(end)
        while i < len(b):
            start[i] = 1
            i = to[i]
        done = np.cumsum(start)
        before = np.r_[0, done][at[:-1]]
        before[0] = -base
        return pdf[["grp", *order]].assign(batch_no=done - np.repeat(before, np.diff(at)) - 1)

    entries = "grp string, seg long, in_blocks long, in_chars long, in_count long"
    parent = F.floor(F.col("seg") / F.lit(fan))
    with scratch():
        many = 1 + units.count() // segment
        cut = units.select("grp", *order, "blocks", "chars").repartitionByRange(many, "grp", *order).select("*", F.spark_partition_id().cast("long").alias("seg"))
        cut = spill(cut, "segments", outlast=1)  # segments are positions in the sorted table, however sparse ord is
        tree = [spill(cut.groupBy("seg").applyInPandas(sums, f"grp string, seg long, {SUMMARY}"), "summaries", outlast=1)]
        while many > fan:
            tree.append(spill(tree[-1].groupBy("grp", parent).applyInPandas(up, f"grp string, seg long, {SUMMARY}"), "summaries", outlast=1))
            many = -(-many // fan)
        zero = [F.lit(0).cast("long").alias(c) for c in ("in_blocks", "in_chars", "in_count")]
        entry = tree[-1].select("*", *zero).groupBy("grp").applyInPandas(down, entries)
        for level in tree[-2::-1]:
            come = entry.withColumnsRenamed({"grp": "g", "seg": "s"})
            entry = level.join(come, F.col("grp").eqNullSafe(F.col("g")) & (parent == F.col("s"))).drop("g", "s").groupBy("grp", parent).applyInPandas(down, entries)
    return cut.groupBy("seg").cogroup(entry.groupBy("seg")).applyInPandas(number, f"grp string, {orders}, batch_no long")


def batch_members(blocks: DataFrame, max_chars: int = MAX_CHARS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The blocks (run, artifact, pos, block_id, artifact_sha256, modality, content), with visual, batch_no, sub_no: their batch.

    A visual block is a batch of its own. Of the others, whole artifacts are packed in order; one that exceeds a limit shares no batch and is packed by
    itself, with blocks over max_chars cut."""
    sized = blocks.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("visual", F.coalesce(F.col("modality") == "VISUAL_ASSET", F.lit(False)))
    pictures = sized.where("visual").withColumns({"batch_no": F.col("pos").cast("long"), "sub_no": F.lit(0).cast("long")})
    texts = sized.where("not visual")
    groups = texts.groupBy("run", "artifact").agg(F.min("pos").alias("ord"), F.count("*").alias("blocks"), F.sum(C.utf16_length(F.col("content"))).alias("chars"))
    placed = greedy(groups.select(F.col("run").alias("grp"), "ord", "blocks", "chars"), max_blocks, max_chars)
    told = null_safe(groups, placed.withColumnRenamed("grp", "run"), ["run", "ord"]).select("run", "artifact", "batch_no", ((F.col("blocks") > max_blocks) | (F.col("chars") > max_chars)).alias("large"))
    rows = null_safe(texts, told, ["run", "artifact"])
    one = F.to_json(F.struct("run", "artifact"))
    cut = split_blocks(rows.where("large"), max_chars).withColumns({"ord": F.col("pos").cast("long"), "sub": F.col("fragment").cast("long"), "g": one})
    inner = greedy(cut.select(F.col("g").alias("grp"), "ord", "sub", F.lit(1).cast("long").alias("blocks"), C.utf16_length(F.col("content")).alias("chars")), max_blocks, max_chars)
    cut = cut.join(inner.withColumnsRenamed({"grp": "g", "batch_no": "sub_no"}), ["g", "ord", "sub"])
    names = [*sized.columns, "batch_no", "sub_no"]
    return pictures.select(names).unionByName(rows.where("not large").withColumn("sub_no", F.lit(0).cast("long")).select(names)).unionByName(cut.select(names))


def batches(blocks: DataFrame, max_chars: int = MAX_CHARS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """run, no, batch_id, batch_sha256, n_blocks, chars, tokens, status, modality_mix (in order of appearance), artifacts (sorted) of the batches of blocks, visual ones first."""
    members = batch_members(blocks, max_chars, max_blocks)
    text = F.col("content")
    han, ascii_, other = C.token_parts(text)
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")  # a batch has max_blocks blocks at most
    told = members.groupBy("run", "visual", "batch_no", "sub_no").agg(
        C.prefixed_id("EB", joined("block_id")).alias("batch_id"), F.sha2(joined(F.sha2(text, 256)), 256).alias("batch_sha256"), F.count("*").alias("n_blocks"), F.sum(C.utf16_length(text)).alias("chars"),
        C.tokens_of(F.sum(han), F.sum(ascii_) + F.count("*") - 1, F.sum(other)).alias("tokens"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "modality"))), lambda x: x["modality"])).alias("modality_mix"),
        F.array_sort(F.collect_set("artifact")).alias("artifacts"),
    )
    order = Window.partitionBy("run").orderBy(F.desc("visual"), "batch_no", "sub_no")
    limit = F.lit(float(C.token_limit(max_chars)))
    return told.select("run", F.row_number().over(order).alias("no"), "batch_id", "batch_sha256", "n_blocks", "chars", "tokens", C.budget_status(F.col("tokens").cast("double"), limit).alias("status"), "modality_mix", "artifacts")


def batch_ids(members: DataFrame) -> DataFrame:
    """grp, batch_no, batch_id, batch_sha256, n_blocks of batches given by rows (grp, batch_no, block_id, content_sha256). A batch has MAX_BLOCKS blocks at most."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    return members.groupBy("grp", "batch_no").agg(C.prefixed_id("EB", joined("block_id")).alias("batch_id"), F.sha2(joined("content_sha256"), 256).alias("batch_sha256"), F.count("*").alias("n_blocks"))


def material_packets(chunks: DataFrame, allowed: list[str], max_tokens: int = 48000) -> DataFrame:
    """grp, packet_no, packet_id, status, tokens, n_chunks: chunks (grp, ord, chunk_id, domain_tags, tokens) with an allowed tag, packed in order; one over 1.2 times the limit is BLOCKED alone."""
    own = chunks.where(F.arrays_overlap("domain_tags", F.array(*[F.lit(a) for a in allowed])))
    bar = int(max_tokens * 1.2)
    # what stands alone is what exceeds bar; a chunk between the limits starts a packet and fills it
    units = own.select("grp", "ord", F.lit(1).cast("long").alias("blocks"), F.when(F.col("tokens") > bar, F.lit(max_tokens + 1)).otherwise(F.least("tokens", F.lit(max_tokens))).alias("chars"))
    placed = greedy(units, NO_LIMIT, max_tokens)
    rows = null_safe(own, placed, ["grp", "ord"])
    return rows.groupBy("grp", "batch_no").agg(
        C.prefixed_id("MP", F.array_join(F.array_sort(F.collect_list("chunk_id")), ",")).alias("packet_id"),
        F.when(F.max("tokens") > bar, "BLOCKED").otherwise("RUNNABLE").alias("status"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_chunks"),
    ).withColumnRenamed("batch_no", "packet_no")
