from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from procloom.llm import packing, queries, tokencount

from . import nasty

SF = "/root/testdata/sf0.001"
WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
SLOW = settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
MIXED = st.text(alphabet=st.one_of(st.sampled_from("aeinrst 'S\n\t.,!0123456789<|>éßÀ漢字́ \u0085Σς"), st.characters(exclude_categories=("Cs",))), max_size=120)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def library(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


@SLOW
@given(MIXED)
def test_transducer_counts_as_the_library(word, text):
    assert tokencount.machine(WORD).tokens([text], chunk=16)[0] == library(word, text)


def test_every_code_point_counts_as_the_library(word):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b{c}{c}1" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    assert [int(tokencount.machine(WORD).tokens([t])[0]) for t in texts] == [library(word, t) for t in texts]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "x" * 5000, "antidisestablishmentarianism" * 40, "it's they're we'll I'd", "ΑΣ ΑΣΑ", "İstanbul ǅ ﬁ", "é é", "퟿", "1234567890", "a​b", "don''t 's's", "!!!???...,,,"])
def test_hard_texts(word, text):
    for chunk in (4, 64, 512):
        assert tokencount.machine(WORD).tokens([text, "", text], chunk=chunk).tolist() == [library(word, text), 0, library(word, text)]


@SLOW
@given(st.text(alphabet="aeinrstx'é0漢", min_size=1, max_size=200), st.sampled_from([7, 40]))
def test_long_words_count_as_the_library(word, text, chunk):
    m = tokencount.machine(WORD)
    assert m.tokens([text, text * 3], chunk=chunk, long=5).tolist() == [library(word, text), library(word, text * 3)]
    data = np.frombuffer(m.normal("".join(c for c in text if c.isalpha()) or "a", True).encode(), np.uint8)
    if m.kinds[[ord(c) for c in data.tobytes().decode()]].tolist() == [2] * len(data.tobytes().decode()):
        assert m.long_word(data, chunk, block=50) == library(word, data.tobytes().decode())


@pytest.mark.parametrize("text", ["".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "x" * 300_000, "ab" * 100_000 + " and " + "abc" * 3000])
def test_a_very_long_word(word, text):
    m = tokencount.machine(WORD)
    before = len(m.states)
    assert m.tokens([text, "a b"]).tolist() == [library(word, text), library(word, "a b")]
    assert len(m.states) < before + 1000


def test_query_counts_as_the_library(spark, word):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op10_token_counts(spark, SF).collect()}
    assert found == {d: (len(t.encode()), n := library(word, t), n > 2048) for d, t in docs.items()}


def test_nasty_rows_are_counted(spark, word):
    df = nasty.docs(spark)
    rows = tokencount.token_counts(df, WORD).collect()
    assert len(rows) == df.count()
    assert {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"] is not None} == {k: library(word, t or "") for k, t in enumerate(nasty.texts())}
    assert tokencount.token_counts(nasty.empty(spark), WORD).count() == 0


@SLOW
@given(MIXED)
def test_ids_are_those_of_the_library(byte, text):
    assert packing.encoder(BYTE).ids(text).tolist() == byte.encode(text, add_special_tokens=False).ids


def whole(rows, docs, byte, size=1024, end=2):
    """Check that pieces are the documents' ids in order, and sequences gapless and within size; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(docs)
    for d, text in docs.items():
        ids = np.array([*byte.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        parts = sorted(by[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // size)
        at = 0
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == size or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_of_all_documents(spark, byte):
    rows = queries.op7_sequence_packing(spark, SF).collect()
    n = whole(rows, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}, byte)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert n <= 1.02 * least + 1


def test_packing_in_many_blocks(spark):
    rng = random.Random(8)
    rows = [(k, 0, 0, rng.choice([3, 50, 400, 513, 700, 1024]), 0, k) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, item long")
    bins = {}
    for r in packing.pack(df, how=packing.Evolution(block_items=100)).collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, bins.values())) == len(rows)
    for places in bins.values():
        assert max(o + n for o, n in places) == sum(n for _, n in places) <= 1024
    # no packing has fewer than one bin for each item over half
    assert len(bins) <= 1.06 * max(-(-sum(r[3] for r in rows) // 1024), sum(r[3] > 512 for r in rows)) + 2


def test_crossover_injects_whole_bins_and_never_loses_an_item():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 600, 300)
    people = []
    for order in (np.argsort(-lengths), rng.permutation(300)):
        bins = np.zeros(300, np.int64)
        packing.best_fit(lengths, order, bins, np.zeros(0, np.int64), 1024)
        people.append(bins)
    for _ in range(20):
        child = packing.crossover(lengths, *people, 1024, 0.95, rng)
        assert np.bincount(child, lengths).max() <= 1024 and len(child) == 300


def test_the_search_beats_best_fit_on_planted_packings():
    size, how, beaten = 1024, packing.Evolution(), 0
    for k in range(6):
        rng = np.random.default_rng(k)
        two = rng.integers(260, 500, (2, 60))  # with a third each, they fill a bin exactly
        three = np.vstack([two, size - two.sum(0)])
        lengths = rng.permutation(three[:, three[2] >= 200].ravel())
        plain = np.zeros(len(lengths), np.int64)
        packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), plain, np.zeros(0, np.int64), size)
        own = [packing.search(lengths, [], size, how, np.random.default_rng(j), plain=j == 0) for j in range(how.islands)]
        best = max(own, key=lambda b: packing.fitness(lengths, b, size))
        assert np.bincount(best, lengths).max() <= size
        found, least = (-packing.fitness(lengths, b, size)[0] for b in (best, plain))
        assert found <= least
        beaten += found < least
    assert beaten >= 4


def test_nasty_rows_are_packed(spark, byte):
    df = nasty.docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    whole(packing.pack(packing.pieces(df, BYTE)).collect(), dict(enumerate(nasty.texts())), byte)
    assert packing.pack(packing.pieces(nasty.docs(spark), BYTE)).where("doc_id is null").count() == 1
    assert packing.pack(packing.pieces(nasty.empty(spark), BYTE)).count() == 0
