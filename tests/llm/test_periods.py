from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from procloom.llm import periods, queries

from ..oracle import connect, rows, sql_rows
from . import nasty

SF = "/root/testdata/sf0.01"


def brute(words, least=6, times=4):
    """(start, length, period) of all runs."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_query_gives_the_rows_of_its_sql(spark):
    columns, wanted = sql_rows(connect(SF), queries.SQL["op12_periodic_runs"])
    df = queries.op12_periodic_runs(spark, SF)
    assert sorted(df.columns) == columns and rows(df) == wanted


def test_runs_of_random_texts_in_one_pass():
    rng = random.Random(12)
    for _ in range(500):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
            if rng.random() < 0.5 and len(words) > 10:
                a, p = rng.randrange(len(words)), rng.randint(1, 6)
                words = words[:a] + [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words))]
            texts.append(words)
        first = np.array([100 * k + w for k, words in enumerate(texts) for w in words], np.int64)
        wanted, base = [], 0
        for words in texts:
            wanted += [[s + base, n, q] for s, n, q in brute(words)]
            base += len(words)
        assert periods.find_runs(first, np.array([len(w) for w in texts])).tolist() == wanted


def test_blocks_of_candidates_give_what_one_block_gives(monkeypatch):
    words = np.array([0, 1, 2] * 200 + list(range(300)) + [7] * 90 + [1, 2] * 50, np.int64)
    whole = periods.find_runs(words, np.array([len(words)])).tolist()
    monkeypatch.setattr(periods, "BLOCK", 64)
    assert periods.find_runs(words, np.array([len(words)])).tolist() == whole == [list(r) for r in brute(words.tolist())]


def test_other_lengths_and_exponents():
    rng = random.Random(3)
    for least, times in ((4, 2), (9, 3), (2, 2)):
        words = [rng.randrange(2) for _ in range(200)]
        assert [tuple(r) for r in periods.find_runs(np.array(words), np.array([200]), least, times).tolist()] == brute(words, least, times)


def test_planted_periods(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 37))) for k in range(400)] + [(None, "a b c")], "doc_id long, text string")
    for r in df.select("doc_id", "text", periods.planted(F.col("text"), F.col("doc_id")).alias("new")).collect():
        words = split(r["text"])
        n = len(words)
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert split(r["new"]) == words


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    found = periods.periodic_runs(df).collect()
    wanted = []
    for r in df.collect():
        words = split(r["text"])
        runs = brute(words) if len(words) < 1000 else []  # the long texts are random words
        wanted.append((r["doc_id"], len(words), runs, collapsed(words, runs)))
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found))) == sorted(map(repr, wanted))
    told = periods.digests(periods.periodic_runs(df.where("doc_id is null or doc_id < 2"))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["n_runs"] == 0 and r["start"] is None and r["exponent_milli"] is None and r["runs_sha256"] == empty and r["collapsed_sha256"] for r in told)
    assert periods.digests(periods.periodic_runs(nasty.empty(spark))).count() == 0
