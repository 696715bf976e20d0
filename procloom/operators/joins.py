"""Joins whose keys may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on columns of these names, a null being equal to a null; the columns come once."""
    come = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(come, same, how).drop(*[f"_r_{c}" for c in on])
