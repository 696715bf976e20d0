from __future__ import annotations

import random

import pytest

from procloom.operators import budget, packing

from .test_text import greedy_by_hand

BLOCKS = "run string, artifact string, pos long, block_id string, artifact_sha256 string, modality string, content string"


def test_null_groups_and_large_positions_are_kept(spark):
    far = 10**12 * 100_000
    rows = [(run, art, far + 100 * j + k, f"{run}-{art}-{k}", "s", "TEXT", "x" * 900) for run in ("r", None) for j, art in enumerate(("a", None)) for k in range(20)]
    rows += [("r", "long", far + 10**6, "l", "s", "TEXT", "y" * 30_000), (None, None, far - 1, "v", "s", "VISUAL_ASSET", None)]
    members = packing.batch_members(spark.createDataFrame(rows, BLOCKS)).collect()
    assert len(members) == len(rows) + 2  # the long block is three
    assert {(r["run"], r["artifact"]) for r in members} == {(a, b) for a in ("r", None) for b in ("a", None)} | {("r", "long")}
    for run, art in (("r", "a"), (None, None)):
        own = sorted((r["pos"], r["sub_no"]) for r in members if (r["run"], r["artifact"]) == (run, art) and not r["visual"])
        assert [s for _, s in own] == [0] * 12 + [1] * 8  # twelve blocks a batch
    assert sorted(len(r["content"]) for r in members if r["artifact"] == "long") == [6000, 12000, 12000]
    assert packing.batches(spark.createDataFrame(rows, BLOCKS)).agg({"n_blocks": "sum"}).first()[0] == len(members)


def test_null_groups_of_packets_and_tasks(spark):
    chunks = spark.createDataFrame([(g, k, f"c{k}", ["L4"], 30) for g in ("a", None) for k in range(4)], "grp string, ord long, chunk_id string, domain_tags array<string>, tokens long")
    packets = packing.material_packets(chunks, ["L4"], 60).collect()
    assert sorted((r["grp"] or "", r["n_chunks"]) for r in packets) == [("", 2), ("", 2), ("a", 2), ("a", 2)]
    tasks = budget.aggregation_tasks(chunks.withColumnRenamed("chunk_id", "result_id"), 60).collect()
    assert sum(r["n_results"] for r in tasks) == 8


def test_order_by_a_second_key(spark):
    units = spark.createDataFrame([("g", 5, s, 1, 4) for s in range(6)] + [("g", -1, 0, 1, 4)], "grp string, ord long, sub long, blocks long, chars long")
    found = sorted((r["ord"], r["sub"], r["batch_no"]) for r in packing.greedy(units, 12, 8, segment=2, fan=2).collect())
    assert [b for _, _, b in found] == [0, 0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("segment", [7, 40, 10_000])
def test_many_groups_are_numbered_by_segment(spark, segment):
    rng = random.Random(segment)
    units = {g: [(rng.randint(1, 4), rng.randint(0, 14)) for _ in range(rng.choice([1, 2, 3, 30]))] for g in (None, "", "ä", "😀", *(f"g{k}" for k in range(60)))}
    df = spark.createDataFrame([(g, 3 * k - 9, b, c) for g, own in units.items() for k, (b, c) in enumerate(own)], "grp string, ord long, blocks long, chars long")
    found = packing.greedy(df, 3, 12, segment=segment, fan=2)
    assert "FlatMapCoGroupsInPandas [seg" in found._jdf.queryExecution().executedPlan().toString()  # one call a segment, not one a group
    rows = sorted(found.collect(), key=lambda r: r["ord"])
    assert {g: [r["batch_no"] for r in rows if r["grp"] == g] for g in units} == {g: greedy_by_hand(own, 3, 12) for g, own in units.items()}
