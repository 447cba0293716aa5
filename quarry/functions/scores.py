"""Confidence, risk and recommendation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.columns import clamp01

#: Without evidence from history a stale file stays below the high tier.
NO_HISTORY_CAP = 0.84


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))


def stale_confidence(overall: Column, structure: Column, symbols: Column, reachable: Column, newer: Column, call_site: Column, history: Column, inbound: Column, same_family: Column) -> Column:
    """Share of 100 points: 25 to begin with, 20 for a live, similar and later replacement, 15 by structure, 15 for history, 10 by symbols, 10 without importers, 5 for the name."""
    points = (
        F.lit(25.0)
        + _points(reachable & (overall >= 0.72) & (newer | call_site), 20)
        + 15.0 * structure
        + _points(history, 15)
        + 10.0 * symbols
        + _points(inbound == 0, 10)
        + _points(same_family, 5)
    )
    whole = clamp01(points / 100.0)
    return F.when(history, whole).otherwise(F.least(whole, F.lit(NO_HISTORY_CAP)))


def recommendation(confidence: Column, risk: Column) -> Column:
    """On unrounded values."""
    return F.when((confidence >= 0.85) & (risk <= 0.20), "safe_delete_candidate").otherwise("review")
