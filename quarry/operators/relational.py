"""Joins with a meaning of their own: ledgers, ancestors, as-of, set differences, neighbours in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partition_accepted(findings: DataFrame, ledger: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(remaining, accepted). Whether the ledger is broadcast is Spark's choice, by its size."""
    keys = ledger.select(key).distinct()
    return findings.join(keys, key, "left_anti"), findings.join(keys, key, "left_semi")


def unmatched(ledger: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    return ledger.join(findings.select(key).distinct(), key, "left_anti")


def asof_latest(left: DataFrame, right: DataFrame, by: str, at: str, left_id: str, carry: Sequence[str]) -> DataFrame:
    """Each left row with the ``carry`` columns of the latest right row of its key strictly before it (else nulls).

    Both sides are put in one ordered stream and the last right row is carried on: one shuffle, no range join.
    """
    payload = F.struct(at, *carry)
    rows = left.select(by, at, F.lit(1).alias("__side"), F.col(left_id).alias("__id"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__p"))
    rows = rows.unionByName(right.select(by, at, F.lit(2).alias("__side"), F.lit(None).cast(left.schema[left_id].dataType).alias("__id"), payload.alias("__p")))
    # at equal times left rows come first, so a right row at the same time does not count
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("__last", F.last("__p", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(F.col("__id").alias(left_id), by, at, *[F.col(f"__last.{c}").alias(f"asof_{c}") for c in (at, *carry)])


def array_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """``df`` with removed and added: what each array has that the other has not."""
    return df.withColumns({"removed": F.array_sort(F.array_except(before, after)), "added": F.array_sort(F.array_except(after, before))})


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``df`` with the previous row's columns as prev_*."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in carry})


def under(df: DataFrame, folders: DataFrame, ancestors: Column, folder: str) -> DataFrame:
    """Rows one of whose ancestors is a listed folder; ancestors are exploded and joined by equality."""
    hits = df.select(*df.columns, F.explode(ancestors).alias(folder)).join(folders.select(folder).distinct(), folder, "left_semi")
    return hits.select(*df.columns).distinct()


def peers(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """``df`` with peer_key: its group if that has ``least`` rows or more, else the whole pool ('*')."""
    own = F.concat_ws("/", *by)
    size = df.groupBy(*by).agg(F.count("*").alias("__n"))
    return df.join(size, list(by), "left").withColumn("peer_key", F.when(F.col("__n") >= least, own).otherwise(F.lit("*"))).drop("__n")
