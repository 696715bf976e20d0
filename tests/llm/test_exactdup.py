from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procloom.llm import exactdup, queries

from ..oracle import connect, rows, sql_rows
from . import nasty

SF = "/root/testdata/sf0.01"
OUT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(texts):
    groups = {}
    for d, t in texts:
        groups.setdefault(t or "", []).append(d)
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


def test_query_gives_the_rows_of_its_sql(spark):
    columns, wanted = sql_rows(connect(SF), queries.SQL["op6_exact_dedup"])
    df = queries.op6_exact_dedup(spark, SF)
    assert sorted(df.columns) == columns and rows(df) == wanted


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab ", max_size=3)), max_size=40), st.sampled_from([1 << 6, 1 << 28]))
def test_groups_are_exact_at_any_size_of_the_filter(spark, texts, bits):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r[c] for c in OUT) for r in exactdup.exact_groups(df, max_bits=bits).collect()) == brute(list(enumerate(texts)))


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    found = {r["doc_id"]: r for r in exactdup.exact_groups(df).collect()}
    assert exactdup.exact_groups(df).count() == df.count()
    assert (found[6]["keep_id"], found[6]["group_size"], found[7]["kept"], found[0]["keep_id"]) == (7, 3, True, 1)
    kept = exactdup.drop_exact(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, *range(len(nasty.texts()))} - {0, 6}
    assert exactdup.exact_groups(nasty.empty(spark)).count() == 0 and exactdup.drop_exact(nasty.empty(spark)).count() == 0


def test_only_possibly_repeated_rows_shuffle_at_any_number_of_ranges(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    shares = []
    real = exactdup.possibly_repeated

    def watch(hashed, bits):
        out = real(hashed, bits)
        shares.append((out.count(), out.where("again").count(), bits))
        return out

    monkeypatch.setattr(exactdup, "possibly_repeated", watch)
    found = exactdup.exact_groups(docs, max_bits=1 << 17).groupBy("group_size").count().collect()
    assert {tuple(r) for r in found} == {(200, 200), (1, 19_800)}
    assert len(shares) == 4 and sum(n for n, _, _ in shares) == 20_000 and all(16 * n <= 2 * bits for n, _, bits in shares)
    assert 200 <= sum(a for _, a, _ in shares) <= 200 + 0.05 * 20_000
