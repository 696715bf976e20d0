from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procloom.llm import mixing, queries

from . import nasty

SF = "/root/testdata/sf0.001"


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by clamping again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, done = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in done]
        free, weight = total - sum(done.values()), sum(w[s] for s in rest)
        over = [s for s in rest if free * w[s] / weight > cap * sizes[s] + 1e-9]
        if not over:
            return done | {s: free * w[s] / weight for s in rest}
        done |= {s: cap * sizes[s] for s in over}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.one_of(st.none(), st.text(alphabet="abZé", min_size=1, max_size=3)), st.integers(1, 1000), min_size=1, max_size=8))
def test_targets_equal_repeated_clamping(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert found == pytest.approx(fill(sizes, (3, 1, 2)))


def test_query_over_all_documents(spark):
    rows = queries.op1_source_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    sizes, of = {}, {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
        of[r["doc_id"]] = r["source"]
    wanted = fill(sizes, (3, 1, 2))
    assert {r["doc_id"]: r["size"] for r in rows} == size
    got = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[of[r["doc_id"]]]
        assert r["target"] == pytest.approx(wanted[of[r["doc_id"]]])
        got[of[r["doc_id"]]] = got.get(of[r["doc_id"]], 0) + r["taken"]
    for s, t in wanted.items():
        largest = max(size[d] for d in of if of[d] == s)
        assert abs(got[s] - t) <= max(0.05 * t, largest)
    again = queries.op1_source_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    out = mixing.mixed(df.where("doc_id is null or doc_id <> 6"))
    assert out.columns == df.columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(nasty.empty(spark)).count() == 0 and mixing.mixed(nasty.empty(spark)).count() == 0
