from __future__ import annotations

import math
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procloom.functions import columns as C
from procloom.operators import packing, splitting
from procloom.plans import models as M
from procloom.sources import markdown

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def greedy_by_hand(units, max_blocks, max_chars):
    out, no, blocks, chars = [], -1, None, 0
    for b, c in units:
        alone = b > max_blocks or c > max_chars
        if blocks is None or alone or blocks + b > max_blocks or chars + c > max_chars:
            no, blocks, chars = no + 1, 0, 0
        blocks, chars = blocks + b, chars + c
        out.append(no)
        if alone:
            blocks = None
    return out


@SLOW
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 15)), min_size=1, max_size=60), st.integers(1, 7))
def test_greedy_equals_one_pass(spark, units, segment):
    df = spark.createDataFrame([("g", k, b, c) for k, (b, c) in enumerate(units)], "grp string, ord long, blocks long, chars long")
    found = [r["batch_no"] for r in packing.greedy(df.orderBy(F.rand(1)), 3, 12, segment).orderBy("ord").collect()]
    assert found == greedy_by_hand(units, 3, 12)


@SLOW
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 9)), min_size=1, max_size=60), st.sampled_from([3, 1 << 30]))
def test_greedy_composes_summaries_as_a_tree(spark, units, blocks):
    df = spark.createDataFrame([(g, 1000 * k, b, c) for g in "ab" for k, (b, c) in enumerate(units)], "grp string, ord long, blocks long, chars long")
    for g in "ab":
        found = [r["batch_no"] for r in packing.greedy(df, blocks, 12, segment=5, fan=2).where(F.col("grp") == g).orderBy("ord").collect()]
        assert found == greedy_by_hand(units, blocks, 12)


def test_summaries_are_as_short_as_a_batch(spark):
    n = 1_000_000
    rng = np.random.default_rng(3)
    limits = packing.Limits(1 << 30, 14_400)
    parts = [packing.summarise(np.ones(50_000, np.int64), rng.integers(20, 200, 50_000), limits) for _ in range(n // 50_000)]
    assert max(len(p.b) for p in parts) < 800 and len(packing.compose(parts, limits).b) < 800
    assert len(packing.summarise(np.ones(n, np.int64), np.zeros(n, np.int64), limits).b) == 1
    df = spark.range(n).select(F.lit("g").alias("grp"), (F.col("id") * 100_000).alias("ord"), F.lit(1).cast("long").alias("blocks"), (F.pmod(F.xxhash64("id"), F.lit(180)) + 20).alias("chars"))
    sums = packing.greedy(df, 1 << 30, 14_400).join(df, ["grp", "ord"]).groupBy("batch_no").agg(F.sum("chars").alias("s"))
    got = sums.agg(F.count("*"), F.max("s"), F.max("batch_no")).first()
    units = [r["chars"] for r in df.orderBy("ord").select("chars").collect()]
    assert got[0] == got[2] + 1 == greedy_by_hand([(1, c) for c in units], 1 << 30, 14_400)[-1] + 1 and got[1] <= 14_400


def test_greedy_takes_null_groups_and_no_rows(spark):
    schema = "grp string, ord long, blocks long, chars long"
    assert packing.greedy(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, 1, 1, 5), (None, 2, 1, 9), ("a", 1, 1, 1)], schema)
    assert sorted((r["grp"] or "", r["ord"], r["batch_no"]) for r in packing.greedy(df, 12, 10).collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


@SLOW
@given(st.text(alphabet="ab \n𠀀é", max_size=80), st.integers(2, 12))
def test_fragments_keep_all_that_is_not_blank(spark, text, limit):
    parts = spark.createDataFrame([(text,)], "t string").select(splitting.fragments(F.col("t"), limit)).first()[0]
    squeeze = lambda s: re.sub(r"\s", "", s)
    assert squeeze("".join(parts)) == squeeze(text)
    if len(text) + text.count("𠀀") > limit and squeeze(text):
        assert all(len(p) <= limit for p in parts)


def test_token_estimate_counts_scripts(spark):
    rows = [("", 0), (None, 0), ("abcd", 1), ("abcde", 2), ("采购", 2), ("采购流程é", 4), ("𠀀", 1)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(C.estimate_tokens(F.col("t")))
    assert [r[0] for r in df.collect()] == [n for _, n in rows]


def test_budget_states(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (12.0, 10.0), (12.1, 10.0), (1.0, 0.0)], "u double, l double").select(C.budget_status(F.col("u"), F.col("l")))
    assert [r[0] for r in df.collect()] == ["BUDGET_OK", "BUDGET_ATTENTION", "BUDGET_ATTENTION", "BUDGET_SPLIT_REQUIRED", "BUDGET_SPLIT_REQUIRED"]


def walk_topics(text):
    cjk = lambda c: 0x3400 <= ord(c) <= 0x4DBF or 0x4E00 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF
    found = set()
    for suffix in C.TOPIC_SUFFIXES:
        at = text.find(suffix)
        while at >= 0:
            start = at
            while start > 0 and at - start < 8 and cjk(text[start - 1]) and text[start - 1] not in C.TOPIC_DELIMITERS:
                start -= 1
            found.add(text[start : at + len(suffix)])
            at = text.find(suffix, at + 1)
    return sorted(found)


@SLOW
@given(st.text(alphabet="采购标准规则与的，a范围", max_size=40))
def test_topics_equal_a_walk(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(C.topics(F.col("t"))).first()[0] == walk_topics(text)


def test_heading_paths_and_blocks(spark):
    found = markdown.blocks(markdown.lines(M.MARKDOWN.df(spark))).where("doc = 'skips'").orderBy("line_start").collect()
    assert [(r["kind"], r["heading_path"], r["content"]) for r in found] == [
        ("TEXT", [], "plain start"), ("TEXT", ["One", "Three"], "deep"), ("TABLE", ["One", "Two"], "| a | b |\n| 1 | 2 |"), ("TABLE", ["Next"], "| c |\n| 3 |"), ("TEXT", ["Next"], "tail"),
    ]


def test_sla_units(spark):
    rows = [("3 个工作日", 3, "WORKING_DAY"), ("两天 5天", 5, "CALENDAR_DAY"), ("2小时", 2, "HOUR"), ("尽快", None, None), (None, None, None)]
    found = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").select(C.parse_sla(F.col("t")).alias("s")).collect()
    assert [(r["s"]["value"], r["s"]["unit"]) if r["s"] else (None, None) for r in found] == [(v, u) for _, v, u in rows]


def test_token_limit_rounds_up():
    assert C.token_limit(12000) == math.ceil(12000 / 1.5) and C.token_limit(1) == 1
