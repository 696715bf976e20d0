"""Rows that every operator must take: nulls in any column, empty and very long texts, ties and repeated rows, extra columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, copies long, kept boolean, row string, tokens array<int>"


def texts() -> list[str | None]:
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    return [None, "", " \t\n ", "one", "one two three four", "one two three four five", base, base, " ".join(near), base.upper(), long, long + " end", "x" * 50_000, "a line that repeats\nA Line that repeats \nother", "a line that repeats\nmore", "\n\n", "é ß 漢字 \U0001f600 text \u0085   nbsp", "<|endoftext|> special <|startoftext|>", "tie tie tie tie tie tie tie tie tie tie"]


def docs(spark: SparkSession) -> DataFrame:
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, None, 7, 8, 9, False, "r", [1]) for k, t in enumerate(texts())]
    rows += [(6, rows[6][1], "en", "s0", None, 7, 8, 9, False, "r", [1])]  # a repeated row
    rows += [(None, "one two three", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
