from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from procloom.llm import quality, queries, shared

from . import nasty

LIMITS = quality.Limits()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_hand(text, limits=LIMITS):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of a text."""
    text, words = text or "", words_of(text)
    n, chars = len(words), sum(map(len, words))
    lines, seen, dup, dup_chars = [x for x in text.split("\n") if words_of(x)], set(), 0, 0
    for line in lines:
        if line in seen:
            dup += 1
            dup_chars += sum(map(len, words_of(line)))
        seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(n - 7)]
    many, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if many[w] > 1:
            inside |= set(range(k, k + 8))
    base = n < 20 or 100 * len(inside) > 30 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    bad = base or dup_chars > limits.line_share * max(chars, 1) or symbols > limits.symbol_share * max(chars, 1)
    for size, limit in limits.gram_shares.items():
        seen, cover = set(), set()
        for k in range(n - size + 1):
            g = tuple(words[k : k + size])
            if g in seen:
                cover |= set(range(k, k + size))
            seen.add(g)
        bad = bad or sum(len(words[k]) for k in cover) > limit * max(chars, 1)
    return n, chars, symbols, dup, len(inside), base, not bad


def found(df):
    return {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert found(queries.op4_quality_rules(spark, sf)) == {r["doc_id"]: by_hand(r["text"]) for r in docs}


def test_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bb", "é", " ", " ", "\n", "#", "\t", " ", "the cat sat on the mat and ran "]) for _ in range(rng.randrange(0, 200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(quality.quality(df)) == {k: by_hand(t) for k, t in enumerate(texts)}


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    assert quality.quality(df).count() == df.count()
    assert found(quality.quality(df.where("doc_id is not null"))) == {k: by_hand(t) for k, t in enumerate(nasty.texts())}
    kept = quality.filter_quality(df)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {k for k, t in enumerate(nasty.texts()) if by_hand(t)[-1]}
    assert quality.quality(nasty.empty(spark)).count() == 0 and quality.filter_quality(nasty.empty(spark)).count() == 0


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    told = queries.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    good, bad = told[told["quality"] == 1], told[told["quality"] == 0]
    assert good["kept"].mean() > 0.99 and bad["kept"].mean() < 0.05


def test_texts_are_measured_in_little_memory(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(5000)}" for _ in range(300)) + "\n" for _ in range(3500)]  # 8 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})

    def kept():
        return np.concatenate([quality.measure(d, o, LIMITS)["kept"] for _, d, o in shared.passes([batch])]).tolist()

    monkeypatch.setattr(shared, "_powers", [np.ones(1, np.uint64)] * 2)
    tracemalloc.start()
    found = kept()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 70  # two workers stand beside the heap of an executor
    monkeypatch.setattr(shared, "PASS_BYTES", 4 << 20)
    assert found == kept()
