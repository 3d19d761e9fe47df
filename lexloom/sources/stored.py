"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in a durable file.

    The table is removed when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_made: dict[tuple, DataFrame] = {}


def stored_once(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored on first use for the session's life under ``name`` and ``key``; several plans may read it."""
    own = (spark.sparkContext.applicationId, shared_dir(spark), name, key)
    if own not in _made:
        _made[own] = stored(make(), name)
    return spark.read.schema(_made[own].schema).parquet(_made[own].stored_at)


def drop_stored(df: DataFrame) -> None:
    """Remove a table that ``stored`` made and that nothing reads any more."""
    _remove(df.sparkSession, df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and its folder with it
        pass
