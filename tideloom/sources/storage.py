"""Folders that all executors share, on whatever file system the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Only a local session may leave it unset (tests) and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: it is computed once, and lineage ends there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes the folder of a durable table that nothing reads any more."""
    if df is not None and getattr(df, "_folder", None):
        remove(df.sparkSession, df._folder)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers N of complete ``version=N`` folders, whether they hold rows or not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done)


def drop_versions(spark: SparkSession, path: str, before: int, keep: int) -> None:
    """Removes complete versions under ``before`` but for the newest ``keep``."""
    for n in [v for v in versions(spark, path) if v < before][: -keep or None]:
        remove(spark, f"{path}/version={n}")
