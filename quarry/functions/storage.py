"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:  # tests and laptops
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return (where if "://" in where else "file://" + os.path.abspath(where)).rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: lineage ends here, and the result outlives executors."""
    path, schema = f"{shared_dir(df.sparkSession)}/quarry/{label}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def local_session() -> SparkSession:
    """The active session, or one for this machine."""
    out = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
