"""Licence scan of paragraphs, with DataFrame functions and Spark ML only.

A paragraph is a line, or neighbouring lines where a known word n-gram runs over the break, as in notices that are
wrapped; it never crosses a line without words. Every paragraph of every text is scored: its words give 2- and
3-grams, each is looked up by its hash among those of the classifier, and the weights of those found are added up.
A paragraph that holds none has the intercepts alone, which is the class unknown, so only grams that are found
leave the scan of the texts.

The classifier is multinomial logistic regression with an L1 penalty (sparse weights), trained on whole notices,
cuts of them, and licence names in many wordings, against prose that comes near them and a bounded sample of the
corpus's own paragraphs as the class unknown. The sample teaches what common prose is; it decides nothing on what is
scored, and paragraphs of it that the template comparison would confirm are left out of it. The unknown class is
calibrated on wordings, cuts and paragraphs that training doesn't see: a logistic curve over the margin of the best
family tells how likely it is right, and a family is named from 0.5 on. A prediction is confirmed by template
comparison: the paragraph must hold, in order, enough of the n-grams of a notice or a short form of its family.

Texts: null and empty have one empty paragraph, which is unknown. Rows that repeat get equal results; any length is
taken whole. Of families with equal scores the one first in order counts. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procloom.llm import shared

UNKNOWN = "unknown"
#: Notices and short licences, from their public texts. Lines break where paragraphs do.
_TEXTS = {
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
You should have received a copy of the GNU Affero General Public License along with this program.
licensed under the GNU Affero General Public License version 3""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
Licensed under the Apache License, Version 2.0
Apache License Version 2.0, January 2004""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
BSD 3-Clause License
BSD 2-Clause License""",
    "CC-BY": """This work is licensed under a Creative Commons Attribution 4.0 International License
This work is licensed under the Creative Commons Attribution 3.0 Unported License
Licensed under CC BY 4.0""",
    "CC-BY-NC": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License
This work is licensed under the Creative Commons Attribution-NonCommercial 3.0 Unported License
Licensed under CC BY-NC 4.0""",
    "CC-BY-SA": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License
This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License
Text is available under the Creative Commons Attribution-ShareAlike License
Licensed under CC BY-SA 4.0""",
    "CC0": """CC0 1.0 Universal public domain dedication
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work
The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law""",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
either version 2 of the License, or (at your option) any later version
You should have received a copy of the GNU General Public License along with this program.
This work is licensed under the GNU General Public License, version 3
GNU GENERAL PUBLIC LICENSE Version 2, June 1991""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
licensed under the GNU Lesser General Public License version 2.1
You should have received a copy of the GNU Lesser General Public License along with this library""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
Released under the MIT License""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
Released under the Mozilla Public License 2.0""",
    "Proprietary": """All rights reserved
All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher
Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
NOTICES = {family: text.split("\n") for family, text in _TEXTS.items()}
#: What the families are called, without the word licence.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public", "Affero General Public", "GNU AGPL", "AGPL", "AGPL-3.0", "AGPLv3", "AGPL-3.0-or-later", "AGPL-3.0-only"],
    "Apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0", "Apache 2", "Apache Software"],
    "BSD": ["BSD", "BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD", "2-clause BSD", "New BSD", "Modified BSD", "Simplified BSD"],
    "CC-BY": ["CC BY", "CC BY 4.0", "CC BY 3.0", "CC-BY", "CC-BY-4.0", "CC-BY-3.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0"],
    "GPL": ["GNU General Public", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-3.0-or-later", "GPL-2.0-only", "GPL version 2", "GPL version 3"],
    "ISC": ["ISC"],
    "LGPL": ["GNU Lesser General Public", "Lesser General Public", "GNU LGPL", "LGPL", "LGPL-2.1", "LGPLv3", "LGPL-3.0", "LGPL-2.1-or-later"],
    "MIT": ["MIT", "MIT X11", "Expat MIT"],
    "MPL-2.0": ["Mozilla Public", "MPL 2.0", "MPL-2.0", "MPL", "MPLv2"],
    "Unlicense": ["Unlicense"],
}
#: Short forms of a name that confirm a prediction.
FORMS = ["{} license", "{} licence", "{} licensed", "under {}", "license {}", "licence {}", "SPDX-License-Identifier: {}"]
#: Wordings that training sees, and others by which the unknown class is calibrated.
WORDINGS = [
    "Released under the {} License", "Licensed under the {} license", "Licensed under {}", "Distributed under the {} license", "Available under the terms of the {} licence", "this project uses the {} license",
    "License: {}", "SPDX-License-Identifier: {}", "{} licensed", "the code is {} licensed", "under the terms of the {} License", "published under {}", "it is under the {} licence, see the file", "{} License",
]
HELD_WORDINGS = ["we ship the package under the {} license", "{} license applies to all files", "all code here is under {}", "covered by the {} licence", "Dual license: {} or commercial", "copying is allowed by the {} License only"]
#: What stands in for a name in prose that is no notice, and such prose.
FILLERS = ["state", "driver's", "fishing", "open", "commercial", "new", "same", "pressure", "contract", "his pseudonym", "new management", "supervision", "music", "harvest", "marriage"]
PROSE = [
    "the license of the driver expired last year", "The reserved rights of all citizens", "all the rights of the tenants were kept", "a table was reserved for two", "he has all rights to be angry", "under the terms of the contract the tenant pays", "the general public is asked to stay away",
    "the software is provided by the new vendor", "permission is granted by the office", "he was granted free entry to the public garden", "redistribution of land and use of water", "they used it for any purpose", "a copy of the letter was sent to the author", "you may not use this door",
    "the work is done by the author", "in compliance with the law", "the foundation published a version of the letter", "the public domain of the king", "creative work is common here", "the names of its members may be used", "no part of this garden may be used", "the above picture shows the house",
    "licensed to sell beer under the law", "the notice shall be included in the parcel", "without warranty the car is cheap", "provided that the weather is good", "subject to the following changes", "strictly prohibited by the police", "the copyright holder was asked", "any later version of the story",
]

#: ASCII but letters, digits, points and hyphens; Latin-1 and general punctuation; ideographic space and stops.
_SEPARATORS = r"[\x00-,/:-`{-\xBF\x{2000}-\x{206F}\x{3000}-\x{3003}]+"


def lower_words(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _SEPARATORS), lambda w: F.trim(w, F.lit(".-"))), lambda w: w != "")


def word_array(text: Column) -> Column:
    """Lower-case words: runs of letters, digits, and points or hyphens within them."""
    return lower_words(F.lower(text))


def grams(words: Column, lengths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The words (best a column, as each gram reads them) and their neighbours joined in twos and threes."""
    n = F.size(words)

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
        return F.when(n >= k, F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, lengths))


def templates() -> list[tuple[str, str]]:
    """(family, text) of all notices and short forms."""
    named = [(f, form.format(n)) for f, ns in NAMES.items() for n in ns for form in FORMS]
    return [(f, line) for f, lines in NOTICES.items() for line in lines] + named


def examples(seed: int = 23) -> list[tuple[str, str, bool]]:
    """(family, paragraph, held back for calibration) that the classifier learns from beside the corpus's own paragraphs."""
    rng = random.Random(seed)
    out = [(f, w.format(n), held) for f, ns in NAMES.items() for n in ns for held, ws in ((False, WORDINGS), (True, HELD_WORDINGS)) for w in ws]
    for family, line in templates():
        words = line.split()
        out.append((family, line, False))
        for held in (False, False, True):  # a cut of a long notice, and the notice among other words
            if len(words) > 12:
                start = rng.randrange(len(words) // 2)
                out.append((family, " ".join(words[start : start + rng.randrange(10, len(words))]), held))
        if len(words) > 6 or line in NOTICES[family]:
            out += [(family, f"x0 x1 x2 {line} x3 x4", False), (family, f"{line} z0", False), (family, f"Copyright (c) y0 y1. {line}", True)]
        if len(words) > 6:
            out += [(UNKNOWN, " ".join(rng.sample(words, len(words))), held) for held in (False, True)]  # its words in no order
    out += [(UNKNOWN, w.format(x), k % 3 == 0) for k, x in enumerate(FILLERS) for w in [*WORDINGS, *HELD_WORDINGS]]
    return out + [(UNKNOWN, p, k % 3 == 0) for k, p in enumerate(PROSE)]


@dataclass
class Classifier:
    """grams has (words, weight by class); slope and offset make the margin of the best family the probability that it is right."""

    families: list[str]
    grams: list[tuple[list[str], list[float]]]
    intercepts: list[float]
    slope: float
    offset: float


#: Everyday words; a gram that begins with two of them tells nothing of licences, and is left out.
EVERYDAY = frozenset("a all an and any are as at be by for from if in is it its may must no not of on or other that the this to under with without you your".split())


def gram_list(text: str) -> list[str]:
    """The grams of a fixed text, as grams() has them, that don't begin with two everyday words."""
    words = _fixed_words(text)
    return [" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1) if not EVERYDAY.issuperset(words[i : i + 2])]


def _fixed_words(text: str) -> list[str]:
    """word_array() of an ASCII text."""
    cleaned = "".join(c if c.isalnum() or c in ".-" else " " for c in text.lower())
    return [w for w in (x.strip(".-") for x in cleaned.split()) if w]


def spec(spark: SparkSession, families: list[str]) -> DataFrame:
    """k (number of the family), template, words and g (a gram as array and string), size (grams of the template): a table of the fixed texts."""
    told = [(families.index(f), t, g, len(set(gs))) for t, (f, text) in enumerate(templates()) for gs in [gram_list(text)] for g in sorted(set(gs))]
    return spark.createDataFrame(told, "k long, template int, g string, size int").withColumn("words", F.split("g", " "))


def train(docs: DataFrame, max_unknown: int = 3000, overlap: float = 0.6, seed: int = 23) -> Classifier:
    """A classifier from the fixed texts and at most max_unknown paragraphs of docs, of which a third is held back for calibration."""
    spark = docs.sparkSession
    families = [*sorted(NOTICES), UNKNOWN]
    with shared.scratch():
        # bounded sample: whole documents are chosen by hash, then lines of theirs
        few = shared.sample(docs.select("doc_id", "text").where("text is not null"), max_unknown // 4, seed)
        drawn = few.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph")).orderBy(F.xxhash64(F.lit(seed), "doc_id", "line"), "doc_id", "line").limit(max_unknown)
        drawn = shared.spill(drawn.withColumn("id", F.monotonically_increasing_id()), "drawn")
        notice = drawn.select("id", word_array(F.col("paragraph")).alias("w")).select("id", F.explode(F.array_distinct(grams(F.col("w"), (2, 3)))).alias("g")).join(F.broadcast(spec(spark, families)), "g")
        notice = notice.groupBy("id", "template", "size").agg(F.count("*").alias("n")).where(F.col("n") >= overlap * F.col("size")).select("id").distinct()
        drawn = drawn.join(notice, "id", "left_anti").select(F.lit(UNKNOWN).alias("family"), "paragraph", (F.pmod(F.xxhash64("doc_id", "line"), F.lit(3)) == 0).alias("held"))
        rows = spark.createDataFrame(examples(seed), "family string, paragraph string, held boolean").unionByName(drawn)
        vocabulary = sorted({g for _, p, _ in examples(seed) for g in gram_list(p)})
        counts = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
        label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
        table = counts.transform(rows.withColumn("w", word_array(F.col("paragraph"))).withColumn("grams", grams(F.col("w"), (2, 3))))
        # all classes count alike, but unknown, which is most varied, as much as half of the families
        weight = F.count("*").over(Window.partitionBy("held")) / F.count("*").over(Window.partitionBy("held", "family")) / len(families)  # of the bounded sample
        table = shared.spill(table.select("features", label.alias("label"), "held", (weight * F.when(F.col("family") == UNKNOWN, len(families) / 2).otherwise(1.0)).alias("weight")).coalesce(4), "training")
        model = LogisticRegression(regParam=0.0005, elasticNetParam=1.0, family="multinomial", weightCol="weight", maxIter=40, standardization=False).fit(table.where("not held"))
        known = F.slice(vector_to_array("probability"), 1, len(families) - 1)
        best = F.least(F.greatest(F.array_max(known), F.lit(1e-12)), F.lit(1 - 1e-12))
        told = model.transform(table.where("held")).select(array_to_vector(F.array(F.log(best / (1 - best)))).alias("x"), (F.col("label") == F.array_position(known, F.array_max(known)) - 1).cast("double").alias("y"))
        told = shared.spill(told.coalesce(1), "held")
        share = told.agg(F.mean("y")).first()[0]
        told = told.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))  # as many of both kinds
        curve = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-4, standardization=False).fit(told)
    weights = model.coefficientMatrix.toArray()
    return Classifier(families, [(g.split(" "), weights[:, k].tolist()) for k, g in enumerate(vocabulary)], model.interceptVector.tolist(), float(curve.coefficients[0]), float(curve.intercept))


def gram_hash(words: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, k) for k in range(n)])


def hits(docs: DataFrame, vocabulary: list[list[str]]) -> DataFrame:
    """row, doc_id, n_paragraphs, hits (first and last line, gram) of each row of docs; row tells rows apart."""
    spark = docs.sparkSession
    twos = spark.createDataFrame([(g,) for g in vocabulary if len(g) == 2], "g array<string>").select(gram_hash(F.col("g"), 2).alias("h")).distinct()
    among = ", ".join(f"{r['h']}L" for r in twos.collect())  # of the fixed texts
    lines = F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")
    read = docs.select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").cast("long").alias("n_paragraphs"), F.transform("lines", lower_words).alias("nested"))
    read = read.select("doc_id", "n_paragraphs", F.flatten("nested").alias("w"), F.flatten(F.transform("nested", lambda ws, k: F.array_repeat(k, F.size(ws)))).alias("at"))
    # a three-word gram begins with a two-word gram that is known as well, so the twos find the places
    paired = read.select("*", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, b)).alias("two"))
    placed = paired.select("*", F.expr(f"filter(transform(two, (g, i) -> if(g in ({among}), i, null)), i -> i is not null)").alias("places"))
    line = lambda i: F.get("at", i)
    near = lambda i: line(i + 1) - line(i) <= 1  # a gram goes to the next line, but not over one without words
    two = lambda i: F.when(near(i), F.struct(line(i).alias("first"), line(i + 1).alias("last"), F.get("two", i).alias("gram")))
    three = lambda i: F.when(near(i) & near(i + 1), F.struct(line(i).alias("first"), line(i + 2).alias("last"), F.xxhash64(*[F.get("w", i + k) for k in range(3)]).alias("gram")))
    found = F.filter(F.flatten(F.transform("places", lambda i: F.array(two(i), three(i)))), lambda h: h.isNotNull())
    return placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_paragraphs", found.alias("hits"))


def scan(docs: DataFrame, by: Classifier, overlap: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed (lines of paragraphs that name a family), families (comma-separated, in order) and probability (greatest) of each row of docs."""
    spark = docs.sparkSession
    n = len(by.families)
    with shared.scratch():
        rows = shared.spill(hits(docs.select("doc_id", "text"), [g for g, _ in by.grams]), "hits", outlast=1)
    hashed = F.when(F.size("words") == 2, gram_hash(F.col("words"), 2)).otherwise(gram_hash(F.col("words"), 3)).alias("gram")
    known = spark.createDataFrame(by.grams, "words array<string>, weights array<double>").select(hashed, "weights")
    each = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(F.broadcast(known), "gram")  # a table of the fixed texts' grams
    # gaps and islands: a paragraph goes on while some gram reaches its next line
    order = Window.partitionBy("row").orderBy("first", "last", "gram")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("fresh", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    each = each.withColumn("paragraph", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    once = each.groupBy("row", "paragraph", "gram").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("weights").alias("weights"))
    total = once.groupBy("row", "paragraph").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("gram").alias("grams"), *[F.sum(F.get("weights", F.lit(k))).alias(f"s{k}") for k in range(n)])
    logits = [F.col(f"s{k}") + F.lit(by.intercepts[k]) for k in range(n)]
    scored = total.select("row", "paragraph", "first", "last", "grams", F.array(*logits).alias("all")).withColumn("best", F.array_max(F.slice("all", 1, n - 1)))
    scored = scored.withColumn("k", F.array_position("all", F.col("best")) - 1)
    others = F.aggregate(F.transform("all", lambda x, i: F.when(i == F.col("k"), F.lit(0.0)).otherwise(F.exp(F.greatest(x - F.col("best"), F.lit(-700.0))))), F.lit(0.0), lambda a, b: a + b)
    scored = scored.withColumn("probability", 1 / (1 + F.exp(-(F.lit(by.offset) - F.lit(by.slope) * F.log(F.greatest(others, F.lit(1e-12)))))))
    scored = scored.where("probability >= 0.5").select("row", "paragraph", "first", "last", "grams", "k", "probability")
    # template comparison: enough of the n-grams of one of the family's templates
    parts = spec(spark, by.families).select("k", "template", "size", hashed)
    near = scored.withColumn("gram", F.explode("grams")).join(F.broadcast(parts), ["k", "gram"])  # fixed texts
    near = near.groupBy("row", "paragraph", "k", "template", "size", "first", "last", "probability").agg(F.count("*").alias("held")).where(F.col("held") >= overlap * F.col("size"))
    confirmed = near.select("row", "paragraph", "k", "first", "last", "probability").distinct()
    names = F.transform(F.array_sort(F.collect_set("k")), lambda k: F.get(F.array(*[F.lit(f) for f in by.families]), k.cast("int")))
    found = confirmed.groupBy("row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_licensed"), F.array_join(names, ",").alias("families"), F.max("probability").alias("probability"))
    told = rows.select("row", "doc_id", "n_paragraphs").join(found, "row", "left")
    return told.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce(F.round("probability", 6), F.lit(0.0)).alias("probability"))
