"""Secret scans with an incremental blob ledger.

Every version of a file is told by the SHA-256 of its content, its blob. The ledger is a table in a shared folder that holds,
for each blob, which rule versions have read it and what they found. A scan takes the versions at hand, of whatever paths
and revisions, and reads only blobs with a rule version that the ledger lacks for them, each once however many paths hold it
and with the lacking rules only. Then findings are joined back from the ledger to all versions.

A rule's version is a hash of its definition, so a changed rule reads all blobs again and an unchanged one none. A row of the
ledger is whole by itself and scanning is repeatable: rows that a lost run has left or that two runs write at once are merged
when they are read.

Which rules a blob lacks goes along as a bit mask by place in the rules at hand. No text shuffles where up to FEW blobs are to be read, or where a bitmap over the versions that aren't to be read (copies, and
blobs that the ledger knows) or over those that are clears a row; other rows are joined.

Texts: null counts as empty, and an empty text is a blob like others. Texts of any length are read whole. Equal texts are one blob,
and rows that repeat get the same findings each. A null doc_id is a version like others. Other columns are ignored. An empty
table gives an empty result. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: leftmost matches that don't overlap; those whose group has fewer than least characters are dropped.
    folded: A-Z of the text is read as a-z. needle: what each match holds (folded as well)."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    folded: bool = False
    needle: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.pattern, self.least, self.group, self.folded)).encode()).hexdigest()[:12]}"


#: The base kinds, and public forms of keys and logins.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)", 12, 2, folded=True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, needle="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needle="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,400}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needle=".eyJ"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", needle="_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", needle="AIza"),
    Rule("login", r"://[A-Za-z0-9._~%-]{1,100}:[A-Za-z0-9._~%!$&*+=-]{3,100}@", needle="://"),
)

#: rules: the rule versions that have read the blob; spans: what they found.
LEDGER = "blob binary, rules array<string>, spans array<struct<rule: string, start: bigint, end: bigint>>"


def blob() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def matches(rule: Rule, text: bytes, folded: bytes) -> list[tuple[int, int]]:
    """Spans of a rule in bytes."""
    read = folded if rule.folded else text
    if rule.needle.encode() not in read:
        return []
    return [m.span() for m in re.finditer(rule.pattern.encode(), read) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _places(mask: int) -> list[int]:
    return [k for k in range(mask.bit_length()) if mask >> k & 1]


def scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of the ledger from those with blob, text and lacking (bits of places in rules)."""
    versions = [r.version for r in rules]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in shared.passes(batches):
            whole = data.tobytes()
            lower = whole.lower()  # of bytes: A-Z only
            spans = []
            masks = part.column("lacking").to_pylist()
            for lacking, a, b in zip(masks, offsets[:-1].tolist(), offsets[1:].tolist()):
                text, folded = whole[a:b], lower[a:b]
                found = []
                for k in _places(lacking):
                    found += [(versions[k], s, e) for s, e in matches(rules[k], text, folded)]
                if found and not text.isascii():
                    point = np.r_[0, np.cumsum((data[a:b] & 0xC0) != 0x80)]
                    found = [(v, int(point[s]), int(point[e])) for v, s, e in found]
                spans.append([{"rule": v, "start": s, "end": e} for v, s, e in found])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            read_by = pa.array([[versions[k] for k in _places(m)] for m in masks], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("blob"), read_by, pa.array(spans, kind)], ["blob", "rules", "spans"])

    return rows.select("blob", "text", "lacking").mapInArrow(read, LEDGER)


class Ledger:
    """A ledger in a folder that driver and executors share; it is made when it isn't there."""

    def __init__(self, docs: DataFrame, folder: str) -> None:
        self.spark, self.folder = docs.sparkSession, folder
        self.spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def lacking(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, doc_id (of one version that has it), lacking (bits of the rules that haven't read it; at least one) for blobs of versions (doc_id, blob)."""
        if len(rules) > 62:
            raise ValueError("a scan takes up to 62 rules")
        wanted = F.array(*[F.lit(r.version) for r in rules])
        seen = self.rows().select("blob", F.array_intersect("rules", wanted).alias("rules")).where(F.size("rules") > 0)
        seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        first = versions.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        bit = lambda k, r: F.when(F.array_contains("seen", r.version), 0).otherwise(1 << k).cast("long")
        lacking = reduce(Column.__add__, [F.coalesce(bit(k, r), F.lit(1 << k)) for k, r in enumerate(rules)])
        return first.join(seen, "blob", "left").select("blob", "doc_id", lacking.alias("lacking")).where("lacking > 0")

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen of docs (doc_id, text), write it to the ledger, and give the versions (doc_id, blob), one row for each of docs; they outlast a scratch around the call."""
        shared.ship(self.spark)
        versions = shared.spill(docs.select("doc_id", blob().alias("blob")), "versions", outlast=1)
        with shared.scratch():
            todo = shared.spill(self.lacking(versions, rules), "lacking")
            n_todo, n_all = todo.count(), versions.count()
            if n_todo:
                scanned(self._texts(docs, versions, todo, n_todo, n_all, (1 << len(rules)) - 1), rules).write.mode("append").parquet(self.folder)
        return versions

    def _texts(self, docs: DataFrame, versions: DataFrame, todo: DataFrame, n_todo: int, n_all: int, every: int) -> DataFrame:
        """blob, text, lacking of what is to be read: the joins that a row can't do without, and none of whole texts where a bitmap tells."""
        told = F.xxhash64("doc_id", "blob").alias("_key")  # a row that has another's key by chance is read, too, as a blob of its own
        rows = docs.select("doc_id", "text", blob().alias("blob")).withColumn("_key", told)
        key, out = todo.select(told, "lacking"), ["blob", "text", "lacking"]
        if n_todo <= shared.FEW:
            return rows.join(F.broadcast(key), "_key").select(out)
        if 2 * n_todo <= n_all:
            _, maybe = shared.apart(rows, "_key", key.select("_key"))
            return maybe.join(key, "_key").select(out)
        plain = todo.where(F.col("lacking") == every).select("blob", F.col("doc_id").alias("_id"))
        other = versions.join(plain, "blob", "left").where(~F.col("doc_id").eqNullSafe(F.col("_id")) | F.col("_id").isNull())
        clear, maybe = shared.apart(rows, "_key", other.select(told))
        return clear.withColumn("lacking", F.lit(every).cast("long")).select(out).unionByName(maybe.join(key, "_key").select(out))

    def findings(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """doc_id, blob, spans (kind, start, end; by start, then in the order of rules) of each of the versions, from the ledger."""
        order = F.map_from_arrays(F.array(*[F.lit(r.version) for r in rules]), F.array(*[F.lit(k) for k in range(len(rules))]))
        kind = F.array(*[F.lit(r.kind) for r in rules])
        held = self.rows().select("blob", F.filter("spans", lambda s: s.rule.isin([r.version for r in rules])).alias("spans")).where(F.size("spans") > 0)
        held = held.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
        ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), order[s.rule].alias("order"), s.end.alias("end"))))
        held = held.select("blob", F.transform(ranked, lambda s: F.struct(kind[s.order].alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias("spans"))
        held = shared.spill(held, "findings", outlast=1)
        size = held.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
        if sum(size) <= shared.FEW:
            held = F.broadcast(held)
        none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
        return versions.join(held, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of op11 from those of findings."""
    base = [r.kind for r in RULES[:3]]
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kinds: F.filter("spans", lambda s: s.kind.isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(told(of(base)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
