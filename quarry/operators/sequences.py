"""Ratcliff-Obershelp similarity of token arrays; no built-in expression has it, so Arrow batches go to Python."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        return SequenceMatcher(None, list(x), list(y), autojunk=False).ratio()  # not symmetric: (a, b) in this order

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratios(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``pairs`` with the ratio of the two arrays, 0 if either is empty."""
    return pairs.withColumn(out, _ratio(F.col(a), F.col(b)))
