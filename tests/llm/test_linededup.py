from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from procloom.llm import linededup, queries, shared

from ..oracle import connect, rows, sql_rows
from . import nasty

SF = "/root/testdata/sf0.01"
BLANK = "\t\n\x0b\x0c\r "


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs):
    """(doc_id, text) -> (n_lines, n_dropped, kept text)."""
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [d is not None and len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != d for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in linededup.dedup_lines(df).collect())


def test_query_gives_the_rows_of_its_sql(spark):
    columns, wanted = sql_rows(connect(SF), queries.SQL["op9_line_dedup"])
    df = queries.op9_line_dedup(spark, SF)
    assert sorted(df.columns) == columns and rows(df) == wanted


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_random_lines(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW", few)  # 0: a bitmap tells which texts change
    rng = random.Random(6)
    lines = ["short", "exactly ten", "0123456789", " 0123456789\t", "ABCDEFGHIJ", "abcdefghij", "Éabcdefghi", "éabcdefghi", "", "\x0b\x0c", " nbsp stays here ", "nbsp stays here"]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 8)))) for k in range(60)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    assert found(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    again = spark.createDataFrame([(1, "a line that repeats\nx"), (1, "y\na line that repeats"), (0, "a line that repeats")], "doc_id long, text string")
    assert found(again) == brute([(r["doc_id"], r["text"]) for r in again.collect()])
    assert linededup.dedup_lines(nasty.empty(spark)).count() == 0
    sha = queries.op9_line_dedup(spark, SF).where(F.col("n_dropped") == 0).select("kept_sha256").first()[0]
    assert len(sha) == len(hashlib.sha256(b"").hexdigest())
