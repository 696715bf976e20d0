from __future__ import annotations

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from procloom.llm import queries

from . import nasty
from .test_mixing import fill
from .test_neardup import brute as groups
from .test_quality import by_hand

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def staged(spark, df):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        out.append(df.cache())
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "sequence_packing"]


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, unique, single, mixed, packed = staged(spark, docs)
    wanted = [r for r in docs.collect() if by_hand(r["text"])[-1]]
    assert rows(good) == sorted(map(tuple, wanted), key=repr)
    last = {}
    for r in wanted:
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    wanted = [r for r in wanted if last[r["text"] or ""] == r["doc_id"]]
    assert rows(unique) == sorted(map(tuple, wanted), key=repr)
    comp = groups([(r["doc_id"], r["text"]) for r in wanted], corpus_pipeline.SIMILARITY)
    wanted = [r for r in wanted if comp[r["doc_id"]][1] == r["doc_id"]]
    assert rows(single) == sorted(map(tuple, wanted), key=repr)
    assert mixed.columns == docs.columns
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in wanted}
    sizes, taken, times = {}, {}, {}
    for r in wanted:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    for s, target in fill(sizes, (3, 1, 2)).items():
        assert taken.get(s, 0) == pytest.approx(target, abs=max(0.05 * target, max(size[r["doc_id"]] for r in wanted if r["source"] == s)))
    pieces = packed.collect()
    once = {}
    for r in pieces:
        once.setdefault((r["doc_id"], r["piece"]), []).append(r)
    assert all(len(v) == times[d] for (d, _), v in once.items())
    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    assert {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in ((r["doc_id"], r["text"] or "") for r in wanted) if d in times} == {d: sum(v[0]["length"] for (e, _), v in once.items() if e == d) for d in times}
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_rows_of_the_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == staged(spark, docs)[-1].count()


def test_nasty_rows(spark):
    df = nasty.docs(spark).where("doc_id is null or doc_id <> 6")
    for out in staged(spark, df)[:-1]:
        assert out.columns == df.columns
    assert all(out.count() == 0 for out in staged(spark, nasty.empty(spark)))


def test_run_on_nasty_rows(spark, tmp_path):
    for name, df in (("rows", nasty.docs(spark).where("doc_id is null or doc_id <> 6")), ("none", nasty.empty(spark))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "rows")).collect()
    long, base = [k for k, t in enumerate(nasty.texts()) if t and len(t) > 100_000], nasty.texts().index(nasty.texts()[7])
    assert {r["doc_id"] for r in out} <= {*long, base, base + 1, base + 2, base + 3} and {r["doc_id"] for r in out} & set(long)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_near_copies_from_four_fifths_on_go(spark):
    words = [f"w{k}" for k in range(104)]
    near, far = list(words), list(words)
    near[20] = near[50] = "other"  # 90 of 110 shingles in common
    far[10] = far[35] = far[70] = "else"  # 85 of 115
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(far), "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).orderBy("doc_id").collect()] == [1, 3]
