"""Names composed by Unicode (NFC), which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def compose(names: pd.Series) -> pd.Series:
    """Names in normal form C; null stays null."""
    return names.map(lambda s: unicodedata.normalize("NFC", s) if isinstance(s, str) else None)
