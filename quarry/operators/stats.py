"""Robust outliers, weighted means, tiers and confusion matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact medians. Equal values are counted first, so a group costs memory for its distinct values only."""
    return df.groupBy(*by, value).agg(F.count("*").alias("__n")).groupBy(*by).agg(F.expr(f"percentile(`{value}`, 0.5, __n)").alias(name))


def median_mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by.., median, mad, prevalence, members): median, median distance from it, and share of positive values."""
    med = _median(df, by, value, "median")
    spread = df.join(med, list(by)).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    mad = _median(spread, by, "__d", "mad")
    share = df.groupBy(*by).agg(F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("prevalence"), F.count(value).alias("members"))
    return med.join(mad, list(by)).join(share, list(by))


def robust_z(value: Column, median: Column, mad: Column, floor: Column) -> Column:
    return F.abs(value - median) / F.greatest(F.lit(1.4826) * mad, floor, F.lit(0.15) * F.abs(median))


def outliers(df: DataFrame, by: Sequence[str], value: str, floor: float = 1.0, least_z: float = 3.5, effect: float = 0.0, baseline: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` with median, mad and robust_z whose z is ``least_z`` or more."""
    stats = median_mad(df if baseline is None else baseline, by, value)
    rows = df.join(stats, list(by)).withColumn("robust_z", robust_z(F.col(value), F.col("median"), F.col("mad"), F.lit(floor)))
    return rows.where((F.col("robust_z") >= least_z) & (F.abs(F.col(value) - F.col("median")) >= effect))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    total = F.sum(weight)
    return df.groupBy(*by).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(0.0).alias("weighted_mean"), total.alias("weight"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall (null where nothing was predicted or true)."""
    t, p = F.col(truth), F.col(predicted)
    n = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return n.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
