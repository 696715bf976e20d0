from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from procloom.llm import lexical, queries, shared

from ..oracle import connect, rows, sql_rows
from . import nasty

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score), equal scores by doc_id; docs and items are (id, text)."""
    counts = [(d, c, c.total()) for d, t in docs if (c := Counter(terms(t)))]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            found += [(-score, d is None, d)] * (score > 0)
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def random_texts(rng, n):
    weights = [1 / (k + 1) for k in range(200)]
    return [" ".join(f"t{x}" for x in rng.choices(range(200), weights, k=rng.randint(0, 80))) for _ in range(n)]


def test_query_gives_the_rows_of_its_sql(spark):
    columns, wanted = sql_rows(connect(SF), queries.SQL["op13_lexical_search"])
    df = queries.op13_lexical_search(spark, SF)
    assert sorted(df.columns) == columns and rows(df) == wanted


def test_terms():
    text = "A-b_Ç é漢x\x00\x85y'Z9  k\t\n"
    assert [t.decode() for t in lexical.terms(text.encode()) if t] == terms(text)


@pytest.mark.parametrize(("k", "limit"), [(1, 1_000_000), (5, 0), (20, 1_000_000)])
def test_random_texts_with_ties(spark, monkeypatch, k, limit):
    monkeypatch.setattr(shared, "FEW", limit)  # 0: no table goes to every task
    rng = random.Random(k)
    texts = random_texts(rng, 120)
    docs = [(d, t) for d, t in enumerate(texts + texts[:40])]
    items = [*enumerate(random_texts(rng, 12)), (90, "t0 t0 t0 t1"), (91, ""), (92, None), (93, "nowhere"), (94, texts[3])]
    df = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert found(df) == brute(docs, items, k)


def test_few_documents_and_terms_of_all(spark):
    docs = [(1, "same same other"), (2, "same"), (3, "same third"), (4, None), (5, " ")]
    items = [(1, "same"), (2, "third same"), (3, "other third")]
    df = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(df) == brute(docs, items)


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = [(1, "one two three"), (2, "w1 w2 w3 w4"), (2, "tie line repeats"), (3, None), (None, "éß 漢字 end")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, t int, row int")
    assert found(lexical.search(df, asked)) == brute(docs, items)
    assert lexical.search(nasty.empty(spark), asked).count() == 0
    assert lexical.search(df, asked.limit(0)).count() == 0
