from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from procloom.operators import graph


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "g string, src string, dst string")


def cycle_nodes(rows):
    """Nodes that reach themselves, by search from each."""
    out = {}
    for g, s, d in rows:
        out.setdefault((g, s), set()).add(d)
    found = set()
    for g, start in out:
        seen, todo = set(), list(out[g, start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += out.get((g, n), ())
        if start in seen:
            found.add((g, start))
    return found


def longest(nodes, rows):
    rank = {n: 0 for n in nodes}
    for _ in range(len(nodes)):
        for g, s, d in rows:
            rank[g, d] = max(rank[g, d], rank[g, s] + 1)
    return rank


@pytest.mark.parametrize("small", [100_000, 6])
def test_cycles_equal_search(spark, small):
    rng = random.Random(4)
    rows = sorted({(f"g{g}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for g, (n, m) in enumerate([(3, 4), (8, 9), (12, 14), (20, 22), (5, 2), (9, 30)]) for _ in range(m)})
    found = graph.on_cycle(edges_df(spark, rows), small).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == cycle_nodes(rows)


@pytest.mark.parametrize("small", [100_000, 6])
def test_ranks_equal_relaxation(spark, small):
    rng = random.Random(7)
    rows = sorted({(f"g{g}", f"n{a}", f"n{b}") for g, (n, m) in enumerate([(4, 4), (9, 12), (12, 5), (6, 14)]) for _ in range(m) for a, b in [sorted(rng.sample(range(n), 2))]})
    nodes = [(f"g{g}", f"n{k}") for g, n in enumerate([4, 9, 12, 6]) for k in range(n)]
    found = graph.ranks(spark.createDataFrame(nodes, "g string, node string"), edges_df(spark, [*rows, ("g0", "n0", "ghost"), ("g1", "ghost", "n0")]), small)
    assert {(r["g"], r["node"]): r["rank"] for r in found.collect()} == longest(nodes, rows)


def test_ladder_chain_and_many_nodes(spark):
    ladder = [("ladder", f"{k}{a}", f"{k + 1}{b}") for k in range(22) for a in "xy" for b in "xy"]  # 2 ** 22 paths
    chain = [("chain", f"c{k}", f"c{k + 1}") for k in range(1000)]
    df = edges_df(spark, ladder + chain)
    nodes = df.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = {r["g"]: r["m"] for r in graph.ranks(nodes, df).groupBy("g").agg(F.max("rank").alias("m")).collect()}
    assert found == {"ladder": 22, "chain": 1000}
    ring = edges_df(spark, [*ladder, *chain, ("chain", "c1000", "c0")])
    assert graph.on_cycle(ring).groupBy("g").count().collect() == [("chain", 1001)]
    many = spark.range(2_000_000).select((F.col("id") % 50_000).cast("string").alias("g"), F.col("id").cast("string").alias("node"))
    pairs = many.select("g", F.col("node").alias("src"), (F.col("node").cast("long") + 50_000).cast("string").alias("dst")).where("cast(dst as long) < 2000000")
    assert graph.ranks(many, pairs).agg(F.count("*"), F.max("rank")).first() == (2_000_000, 39)
    assert graph.on_cycle(pairs).count() == 0


def test_no_rows(spark):
    none = edges_df(spark, [])
    assert graph.on_cycle(none).count() == 0 and graph.ranks(none.select("g", F.col("src").alias("node")), none).count() == 0


def most_joined(spark):
    """Rows of the largest join of the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    nodes, told, most = store.planGraph(last).allNodes(), store.executionMetrics(last), 0
    for node in (nodes.apply(k) for k in range(nodes.size())):
        metrics = node.metrics()
        for m in (metrics.apply(k) for k in range(metrics.size())):
            value = told.get(m.accumulatorId())
            if "Join" in node.name() and m.name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return most


def test_siblings_are_not_paired(spark):
    n = 3000
    none = F.lit(None).cast("string")
    child = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("node"))
    tree = child.select("node", F.lit("L5").alias("type"), F.lit("p").alias("parent_id")).unionByName(spark.range(2).select(F.when(F.col("id") == 0, "p").otherwise("q").alias("node"), F.lit("L4").alias("type"), none.alias("parent_id")))
    tree = tree.unionByName(spark.createDataFrame([("d", "L5", "q")], tree.schema))
    both = child.crossJoin(spark.createDataFrame([("OUTPUT",), ("INPUT",)], "kind string")).select("node", F.lit("x").alias("name"), "kind")
    alone = spark.createDataFrame([("c1", "y", "OUTPUT"), ("c1", "y", "INPUT"), ("c2", "z", "OUTPUT"), ("c3", "z", "INPUT"), ("d", "x", "OUTPUT"), ("d", "x", "INPUT")], both.schema)
    found = graph.continuity(tree, both.unionByName(alone)).collect()
    assert sorted((r["node"], r["output"], r["reached"]) for r in found) == [("c1", "y", 0), ("d", "x", 0)]  # what only its maker takes in is lost
    assert 0 < most_joined(spark) <= 2 * n
