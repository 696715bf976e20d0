"""Python workers: the package in those of local sessions, and rows that they give bit by bit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of Python objects that a worker holds before it hands them over.
HELD_ROWS = 2048


def ship(spark: SparkSession) -> None:
    """Let local Python workers find this package when the driver was started elsewhere; a cluster gets it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def handed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, few at a time, however many a text gives; what a row doesn't name is null."""
    while held := list(islice(rows, HELD_ROWS)):
        yield pa.RecordBatch.from_pylist(held, schema)
