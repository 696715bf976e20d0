"""Quality rules by repetition coverage.

Words, lines and word n-grams of several lengths get rolling 64-bit hashes, many texts in one numpy pass.
An n-gram that occurred earlier in its text is duplicated; the share of a text's word characters inside
duplicated n-grams (each character once) is compared with a limit for that n, and so is the share inside
lines that repeat an earlier one.

Texts: null counts as empty and fails for having too few words. Any length is taken whole. Equal rows get
equal results. Only doc_id and text are read, so other columns may have any names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procloom.llm import shared

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_U = np.uint64


@dataclass(frozen=True)
class Limits:
    """A text fails below min_words words, with more than repeat_percent % of its words in repeated windows of window
    words, with more than line_share of its characters in repeated lines, or more than gram_shares[n] in duplicated n-grams,
    or with more symbols than symbol_share of its word characters. A boilerplate line that a short text holds twice stays below the shares."""

    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    line_share: float = 0.20
    gram_shares: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.20, 7: 0.20, 9: 0.20, 10: 0.20})
    symbol_share: float = 0.05


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of them come after an equal one."""
    every, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    ascending = np.sort(keys)
    twice = ascending[1:][ascending[1:] == ascending[:-1]]
    if len(twice):
        maybe = np.zeros(1 << 16, bool)  # most keys occur once: look closer only at those that share 16 bits with a repeated one
        maybe[twice & _U(0xFFFF)] = True
        some = np.flatnonzero(maybe[keys & _U(0xFFFF)])
        some = some[np.isin(keys[some], twice)]
        order = some[np.argsort(keys[some], kind="stable")]
        every[some] = True
        later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return every, later


def covered(values: np.ndarray, of: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Which words lie in an n-gram that their text (number in of) holds twice or more; first counts its first occurrence, too."""
    found = np.zeros(len(values) + 1, np.int64)
    if len(values) >= n:
        with np.errstate(over="ignore"):
            keys = shared.mix(shared.grams(values, n) + of[: len(values) - n + 1].astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
        inside = np.flatnonzero(of[: len(keys)] == of[n - 1 :])
        every, later = repeated(keys[inside])
        start = inside[every if first else later]
        found[start] += 1
        found[start + n] -= 1
    return np.cumsum(found[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """The columns of quality() for a pass of texts."""
    n = len(offsets) - 1
    values, starts, ends, of = shared.words(data, offsets)
    count = lambda k, weight=None: np.bincount(k, weight, n)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = lead[ends] - lead[starts]
    n_words, word_chars = count(of), count(of, chars)
    spots = np.flatnonzero(_SYMBOLS[data])
    n_symbols = count(np.searchsorted(offsets, spots, "right") - 1)

    begin, stop = shared.segments(data, offsets, data != 10)
    within = np.r_[0, np.cumsum(chars)]
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    begin, stop, line_chars = begin[last > first], stop[last > first], (within[last] - within[first])[last > first]
    line_of = np.searchsorted(offsets, begin, "right") - 1
    with np.errstate(over="ignore"):
        later = repeated(shared.mix(shared.hashes(data, begin, stop) + line_of.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))[1]
    n_repeat = count(of, covered(values, of, limits.window, first=True))
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_percent * n_words)

    total = np.maximum(word_chars, 1)
    line_share = count(line_of, line_chars * later) / total
    failed = base_failed | (line_share > limits.line_share) | (n_symbols > limits.symbol_share * total)
    worst = np.zeros(n)
    for size, limit in limits.gram_shares.items():
        share = count(of, chars * covered(values, of, size, first=False)) / total
        failed |= share > limit
        worst = np.maximum(worst, share)
    ints = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": count(line_of[later]), "n_repeat_words": n_repeat}
    return {k: v.astype(np.int64) for k, v in ints.items()} | {"base_failed": base_failed, "kept": ~failed, "line_share": line_share, "gram_share": worst}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, gram_share double"


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict (kept) of each row of docs; line_share and gram_share are the shares of characters in repeated lines and in the worst of the n-gram lengths."""
    shared.ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in shared.passes(batches):
            out = measure(data, offsets, limits)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, out.values())], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def filter_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. The texts are judged where they are read; nothing shuffles."""
    shared.ship(docs.sparkSession)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in shared.passes(batches):
            yield rows.filter(pa.array(measure(data, offsets, limits)["kept"]))

    return docs.mapInArrow(select, docs.schema)
