from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest

from procloom.llm import neardup, queries

from . import nasty

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    """doc_id -> (n_shingles, component) by all pairs that share a shingle."""
    sets, root, at = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}, {}
    for d, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(d)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in at[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(df, how=None):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in (neardup.near_groups(df, how) if how else neardup.near_groups(df)).collect()}


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.op3_near_duplicates(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("how", [neardup.Paths(node_limit=8, block=6), neardup.Paths(node_limit=4, block=3, levels=1), neardup.Paths(node_limit=16, levels=0, block=5)])
def test_large_groups_branch_and_are_dealt_into_blocks(spark, how):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for group in range(4):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(80)] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, how) == brute(rows)


@pytest.mark.parametrize("how", [neardup.Paths(percent=80), neardup.Paths(percent=80, held=1500), neardup.Paths(percent=80, node_limit=16, block=24, held=1500)])
def test_rows_that_just_miss_a_large_group_dont_pair_up(spark, monkeypatch, how):
    base, rng = [f"w{k}" for k in range(174)], random.Random(4)
    spots = list(range(5, 170, 6))  # a change at each takes five shingles of its own
    rows = []
    for k in range(110):  # 160 of 180 shingles in common, or more
        own = list(base)
        own[spots[k % 9]] = f"a{k}"
        rows.append((len(rows), " ".join(own)))
    far = set()
    while len(far) < 40:
        far.add(tuple(sorted(rng.sample(spots[9:], 3))))
    for k, changed in enumerate(sorted(far)):  # 150 of 190 with each of the others
        own = list(base)
        for at in changed:
            own[at] = f"b{k}.{at}"
        rows.append((len(rows), " ".join(own)))
    made, write = {}, neardup.shared.spill

    def spill(df, name, *args, **kw):
        out = write(df, name, *args, **kw)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup.shared, "spill", spill)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = result(df, how)
    assert found == brute(rows, 80) and sum(d == c for d, (_, c) in found.items()) == 41
    assert made["pairs"] < 1000  # forests of nodes and of pairs of blocks; there are 4400 pairs with the group alone


def test_parts_bring_each_pair_together():
    rng = np.random.default_rng(3)
    for held, two in ((1 << 20, False), (300, False), (300, True), (1, True)):
        n = rng.integers(10, 200, 90)
        kin = rng.integers(0, 6, 90)
        x, y = np.nonzero((kin[:, None] == kin[None, :]) & (rng.random((90, 90)) < 0.3))
        x, y = (x[(x < 45) & (y >= 45)], y[(x < 45) & (y >= 45)]) if two else (x[x < y], y[x < y])
        part, side, item = neardup.parted(x, y, n, two, held)
        assert len({*zip(part.tolist(), side.tolist(), item.tolist())}) == len(part)
        parts = {}
        for p, s, i in zip(part.tolist(), side.tolist(), item.tolist()):
            parts.setdefault(p, ([], []))[s].append(i)
        assert all(sum(n[one]) <= held + 200 for both in parts.values() for one in both)
        assert all(len({*kin[a + b].tolist()}) == 1 for a, b in parts.values())
        assert {*zip(x.tolist(), y.tolist())} <= {(min(i, j), max(i, j)) for a, b in parts.values() for i in a for j in (b or a)}
        assert held < 1000 or len(parts) == len({*kin[x].tolist()})


def test_nasty_rows(spark):
    df = nasty.docs(spark)
    out = neardup.near_groups(df)
    assert out.count() == df.count()
    found, wanted = result(df.where("doc_id is not null")), brute([(k, t) for k, t in enumerate(nasty.texts())])
    assert found == wanted
    assert found[7][1] == found[8][1] == found[9][1] == 6 and found[0] == (0, 0)
    kept = neardup.drop_near(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, *(d for d, (_, c) in wanted.items() if d == c)}
    assert neardup.near_groups(nasty.empty(spark)).count() == 0 and neardup.drop_near(nasty.empty(spark)).count() == 0


def peak_mb(f, *args):
    tracemalloc.start()
    out = f(*args)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_a_node_of_copies_is_compared_in_little_memory():
    rng = np.random.default_rng(1)
    sketch = np.repeat(rng.integers(0, 256, (1, neardup.SKETCH), np.uint8), 600, 0)
    n = np.full(600, 100)
    (x, y, same), most = peak_mb(neardup.similar, sketch, sketch, n, n, 85)
    assert len(x) == 600 * 600 and (same == neardup.SKETCH).all() and most < 60
    keep, most = peak_mb(neardup.forest, x[x < y], y[x < y], same[x < y], 600)
    assert keep.sum() == 599 and most < 20


def test_pairs_of_a_node_come_once_and_those_that_met_are_told():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (40, neardup.SKETCH), np.uint8)
    sketch = np.where(rng.random((300, neardup.SKETCH)) < 0.05, rng.integers(0, 256, (300, neardup.SKETCH), np.uint8), base[rng.integers(0, 40, 300)])
    n = rng.integers(90, 110, 300)
    x, y, same = neardup.similar(sketch, sketch, n, n, 85)
    later = x < y
    assert 100 < later.sum() < 300 * 299 // 2
    for one, other in zip(neardup.similar(sketch, sketch, n, n, 85, own=True), (x[later], y[later], same[later])):
        assert one.tolist() == other.tolist()
    seen = rng.integers(0, 3, (300, 4))
    assert neardup.met(seen, x, y).tolist() == [any(a == b != 0 for a, b in zip(seen[i], seen[j])) for i, j in zip(x, y)]
