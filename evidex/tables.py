"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidex-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> str:
    """``path``, where something is by now, which goes when the JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_scopes: list[list[DataFrame]] = []


def keep(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage and outlives any executor. The files go when the JVM ends, or earlier
    by :func:`release`; those of a ``lasting`` table are not released with what it was made for.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evidex_path = path
    if _scopes and not lasting:
        _scopes[-1].append(out)
    return out


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make()`` gives, kept, with all tables that were kept for it released."""
    _scopes.append([])
    try:
        out = keep(make(), name)
    finally:
        held = _scopes.pop()
    for df in held:
        if df is not out:
            release(df)
    return out


def release(df: DataFrame) -> None:
    """Delete a kept table that no later step reads; one that is gone already is no error."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._evidex_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``df`` as parts of about ``most`` rows at most, by a hash of ``key``: each is small enough to go to every task."""
    parts = -(-df.count() // most)
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [df]


def spread(df: DataFrame, cores: int | None = None) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for heavy work on rows of a small input.

    An input that is already spread is left as it is: nothing is shuffled at scale.
    """
    n = cores or max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
