"""A corpus run in five stages: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last
return the columns of documents; the mix repeats rows that it takes twice. Stages hand over as Parquet in
the shared folder, so a lost executor costs no finished stage; each table is deleted when the run is done with it.

Rows: a null text counts as empty, has too few words for the quality rules, and goes there, like empty ones and those
of white space. A null source is a source of its own, last in order; null lang and n_chars, and columns beyond those of
documents, whatever their names, pass along. Texts of any length are taken whole. Of equal texts the greatest doc_id stays,
of near copies the smallest; rows that repeat a doc_id go or stay together, and doc_id is taken to tell rows apart otherwise.
A null doc_id is never dropped as a copy. Equal words for the mix are decided by a seeded hash, then doc_id. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procloom.llm import exactdup, mixing, neardup, packing, quality, shared
from procloom.llm.queries import vocabulary


#: Percent of similarity from which documents are near copies, by 5-word shingles.
SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdup.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near(docs, neardup.Paths(percent=SIMILARITY))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: SQL can express neither the tokenizer nor the packing; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with shared.scratch():
        for name, stage in STAGES:
            docs = shared.spill(stage(spark, docs, sf_dir), name, outlast=int(name == STAGES[-1][0]))
    return docs
