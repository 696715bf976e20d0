from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd

from procloom.llm import queries, shared, toxicity

from . import nasty

SF = "/root/testdata/sf0.1"


def auc(y, p):
    rank, n = pd.Series(p).rank().to_numpy(), y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    rows = queries.op2_toxicity(spark, SF).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    told = rows.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    told = told[told["held_out"] & told["toxic"].notna()]
    y = told["toxic"].to_numpy().astype(int)
    assert auc(y, told["score"].to_numpy()) > 0.985
    assert ((told["score"] >= 0.5) == y).mean() > 0.97


def test_margins_express_what_no_sum_of_weights_does():
    m = toxicity.Machine(-1.0, np.array([1, 2]), np.array([2.0, 2.0]), np.array([[2.0], [-2.0]]))  # exclusive or of two terms
    cases = {(): -1.0, (0,): 1.0, (1,): 1.0, (0, 1): -1.0}
    for at, wanted in cases.items():
        assert m.margin(np.zeros(len(at), int), np.array(at, int), 1)[0] == wanted


def test_an_insult_next_to_a_group_is_learnt():
    rng, rows, label = np.random.default_rng(2), [], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append(sorted(({1} if a else set()) | ({2} if b else set()) | {int(x) for x in rng.integers(10, 40, 4)}))
        label.append(float(a and b))
    text, term = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([t for r in rows for t in r])
    m = toxicity.learn(text, term, np.array(label))
    at = np.array([1, 2])
    alone = [m.margin(np.zeros(1, int), np.searchsorted(m.term, [t]), 1)[0] for t in at]
    both = m.margin(np.zeros(2, int), np.searchsorted(m.term, at), 1)[0]
    assert both > 0 > max(alone)


def test_an_exclusive_or_of_two_terms_is_learnt_among_noise():
    rng, rows, label = np.random.default_rng(5), [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted(({1} if a else set()) | ({2} if b else set()) | {int(x) for x in rng.integers(10, 2000, 40)}))
        label.append(float(a != b))
    text, term, label = np.repeat(np.arange(4000), [len(r) for r in rows]), np.array([t for r in rows for t in r]), np.array(label)
    seen = text < 3000
    m = toxicity.learn(text[seen], term[seen], label[:3000])
    assert {1, 2} <= set(m.term.tolist())
    rest = ~seen & np.isin(term, m.term)
    margin = m.margin(text[rest] - 3000, np.searchsorted(m.term, term[rest]), 1000)
    assert auc(label[3000:], margin) > 0.99


def test_nasty_rows_and_no_labels(spark):
    df = nasty.docs(spark)
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = toxicity.fit(df, labels.where("false"))
    assert all(r["predicted"] == 0 for r in toxicity.score(df, nothing).collect())
    assert toxicity.score(nasty.empty(spark), nothing).count() == 0
    assert toxicity.score(nasty.empty(spark), toxicity.fit(nasty.empty(spark), labels)).count() == 0


def by_hand(text, m):
    """Score of one text by its words, and sums over single terms and over all pairs."""
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    found = set()
    for w in words:
        for n in (0, *toxicity.BEGINNINGS):
            if len(w) > n:
                data = np.frombuffer(w[: n or len(w)], np.uint8)
                found.add(int((shared.hashes(data, np.array([0]), np.array([len(data)]))[0] + np.uint64(n)) >> np.uint64(64 - toxicity.BITS)))
    at = [k for k, t in enumerate(m.term.tolist()) if t in found]
    margin = m.bias + sum(m.weight[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for i in at for j in at if i < j)
    return 1 / (1 + math.exp(-margin))


def test_scores_equal_plain_loops_over_pairs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    assert len(m.term) > 20
    texts = [r["text"] for r in docs.limit(120).collect()] + nasty.texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, m).collect()}
    assert all(abs(found[k] - by_hand(t, m)) < 1e-9 for k, t in enumerate(texts))
