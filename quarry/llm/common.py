"""What the operators of this subpackage share: reading, the shared folder, intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests,
    a laptop; local masters only) a folder of our own is made and set for the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    if "://" not in where:
        where = "file://" + os.path.abspath(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quarry_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`store` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._quarry_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Those names, lengthened until ``docs`` has no column of the name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def slices(batches, rows: int = 512):
    """The same rows in smaller batches, so that Python objects made of one are few at a time."""
    for batch in batches:
        for k in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(k, rows)
