from __future__ import annotations

import math
import random
import re

import pytest

from procloom.llm import licenses, queries

from . import nasty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_grams(spark):
    from pyspark.sql import functions as F

    found = spark.createDataFrame([("a b c",), ("a",), ("",)], "t string").select(licenses.grams(licenses.word_array(F.col("t"))).alias("g")).collect()
    assert [r["g"] for r in found] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_query_finds_the_licence_lines(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op8_license_scan(spark, SF).collect()}
    assert set(found) == set(docs)
    held = {d for d, t in docs.items() if re.search(r"(?i)(licen[sc]ed?|released) under|all rights reserved|public domain|permission is hereby granted|SPDX-License", t)}
    named = {d for d, r in found.items() if r["families"]}
    assert held and len(named & held) >= 0.97 * len(held)
    assert len(named - held) <= 0.005 * len(docs)
    assert all(r["n_paragraphs"] == docs[d].count("\n") + 1 and (r["n_licensed"] > 0) == bool(r["families"]) for d, r in found.items())


@pytest.mark.parametrize(("text", "families"), [("Released under the MIT License.", "MIT"), ("intro words\nThis work is licensed under the GNU General Public License, version 3.\nmore", "GPL"), ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("we went to the market and bought apples", ""), ("the license of the driver expired last year", "")])
def test_families(spark, trained, text, families):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(df, trained).first()["families"] == families


def test_nasty_rows(spark, trained):
    df = nasty.docs(spark)
    out = licenses.scan(df.where("doc_id is not null"), trained).collect()
    assert {r["doc_id"] for r in out} == set(range(len(nasty.texts()))) and all(r["families"] == "" for r in out)
    assert licenses.scan(nasty.empty(spark), trained).count() == 0


def test_words_of_notices_in_the_sample_take_no_paragraph_out(spark):
    prose = ["all of them went home", "the rights of way were kept", "a table was reserved for two", "the shop is licensed to sell beer", "they sat under the tree", "it scored 4.0 of five", "MIT licence applies", "the dog ran by the cc office"]
    by = licenses.train(spark.createDataFrame([(k, prose[k % len(prose)]) for k in range(400)], "doc_id long, text string"))
    texts = {1: "All rights reserved", 2: "Licensed under CC BY 4.0", 3: "Released under the MIT License", 4: "They sat under the tree"}
    found = {r["doc_id"]: r["families"] for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), by).collect()}
    assert found == {1: "Proprietary", 2: "CC-BY", 3: "MIT", 4: ""}


WORDINGS = ["We publish this library under the {} licence", "the sources are {} licensed", "It is free software under the {} License", "for details of the {} license see the website", "all contributions fall under {}"]
PROSE = ["the licence fee of the television rose", "rights and duties of all members", "she was given a fishing license", "under the roof of the house", "the apache rode to the river", "MIT opened a new laboratory", "the public was reserved", "version 2 of the story is better", "he distributed copies of the letter under a false name", "the terms of the general agreement"]


def test_recall_on_wordings_that_training_never_sees(spark, trained):
    assert not set(WORDINGS) & {*licenses.WORDINGS, *licenses.HELD_WORDINGS} and not set(PROSE) & set(licenses.PROSE)
    made = [(f, w.format(n)) for f, ns in licenses.NAMES.items() for n in ns for w in WORDINGS]
    found = {r["doc_id"]: r["families"] for r in licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(made)], "doc_id long, text string"), trained).collect()}
    right = sum(found[k] == f for k, (f, _) in enumerate(made))
    assert right >= 0.9 * len(made), (right, len(made))
    assert all(r["families"] == "" for r in licenses.scan(spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string"), trained).collect())


def by_hand(text, by):
    """(licensed lines, families, probability) of one text, by plain loops over the lines and the classifier's numbers."""
    weights, shapes = {" ".join(g): w for g, w in by.grams}, [(f, set(licenses.gram_list(t))) for f, t in licenses.templates()]
    words = [(w, k) for k, line in enumerate((text or "").lower().split("\n")) for w in (x.strip(".-") for x in re.split(r"[^a-z0-9.\-\u00c0-\u1fff\u2070-\u2fff\u3004-\U0010ffff]+", line)) if w]
    found = []
    for i in range(len(words)):
        for n in (2, 3):
            run = words[i : i + n]
            gram = " ".join(w for w, _ in run)
            if len(run) == n and gram in weights and all(b - a <= 1 for (_, a), (_, b) in zip(run, run[1:])):
                found.append((run[0][1], run[-1][1], gram))
    islands, reach = [], -1
    for first, last, gram in sorted(found):
        if first > reach:
            islands.append([])
        islands[-1].append((first, last, gram))
        reach = max(reach, last)
    lines, families, best = 0, set(), 0.0
    for island in islands:
        grams = {g for _, _, g in island}
        scores = [b + sum(weights[g][k] for g in grams) for k, b in enumerate(by.intercepts)]
        k = max(range(len(scores) - 1), key=lambda j: scores[j])
        margin = -math.log(sum(math.exp(x - scores[k]) for j, x in enumerate(scores) if j != k))
        p = 1 / (1 + math.exp(-(by.offset + by.slope * margin)))
        if p >= 0.5 and any(f == by.families[k] and len(t & grams) >= 0.6 * len(t) for f, t in shapes if t):
            lines, best = lines + max(b for _, b, _ in island) - min(a for a, _, _ in island) + 1, max(best, p)
            families.add(by.families[k])
    return lines, ",".join(sorted(families)), round(best, 5)


def test_scan_equals_plain_loops(spark, trained):
    rng = random.Random(3)
    pool = [t for _, t, _ in licenses.examples()] + PROSE + ["", " ", "# it -- ends. here."]
    texts = [rng.choice(["\n", " ", "\n\n"]).join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(150)] + [None, "a" * 30_000]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_licensed"], r["families"], round(r["probability"], 5)) for r in licenses.scan(df, trained).collect()}
    wanted = {k: by_hand(t, trained) for k, t in enumerate(texts)}
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in wanted.items()}
    assert all(found[k][2] == pytest.approx(wanted[k][2], abs=2e-5) for k in found)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_notices_wrapped_over_lines(spark, trained):
    mit = licenses.NOTICES["MIT"][2].split()
    made = {
        1: (BSD, "BSD", None), 2: ("intro of it\n\n" + "\n".join(f"# {' '.join(mit[k : k + 3])}" for k in range(0, len(mit), 3)) + "\n\nthe end", "MIT", None),
        3: ("Released under\nthe MIT License", "MIT", 2), 4: ("Released under the MIT License\nmore of the words\nAll rights reserved", "MIT,Proprietary", 2), 5: ("Released under\n\nof the\n\nmarket", "", 0),
    }
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _, _) in made.items()], "doc_id long, text string"), trained).collect()}
    for k, (text, families, n) in made.items():
        assert found[k]["families"] == families and found[k]["n_paragraphs"] == text.count("\n") + 1
        assert n is None or found[k]["n_licensed"] == n
    assert found[1]["n_licensed"] >= 4
