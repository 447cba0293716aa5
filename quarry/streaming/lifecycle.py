"""Streams: windowed counts of events, and the life of findings from scan to scan. Additions; the batch engine needs none of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIFE = "id string, scan long, state string"


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events in tumbling windows; those later than the watermark are left out by Spark. Works on batches too."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    out = rows.groupBy(F.window(at, size), by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def lifecycle(seen: DataFrame) -> DataFrame:
    """(id, scan, state) of a stream of (id, scan, present): new, persisting or resolved. The state is one flag an id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there = bool(state.get[0]) if state.exists else False
        rows = pd.concat(batches).sort_values("scan")
        out = []
        for scan, present in zip(rows.scan, rows.present, strict=True):
            if present or there:
                out.append((key[0], int(scan), "resolved" if not present else "persisting" if there else "new"))
            there = bool(present)
        state.update((there,))
        yield pd.DataFrame(out, columns=["id", "scan", "state"])

    return seen.groupBy("id").applyInPandasWithState(step, LIFE, "present boolean", "append", GroupStateTimeout.NoTimeout)
