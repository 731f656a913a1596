"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset on a local master, a temporary folder that goes with the driver."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodewatch.own.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        own = tempfile.mkdtemp(prefix="lodewatch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("lodewatch.own.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_dir(spark)}/lodewatch/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """A path that no other table has."""
    return f"{spark.conf.get(_STEPS, None) or session_dir(spark)}/{name}-{uuid.uuid4().hex}"


_STEPS, _RELEASE = "lodewatch.own.steps.dir", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, and not when the driver's garbage is collected; for queries that are run once."""
    old = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, old)


@contextmanager
def few_at_once(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Within it, tables are read so many rows at a time; for rows of some hundred kilobytes, of which the usual 4096 are a gigabyte."""
    old = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old) if old else spark.conf.unset(_BATCH)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Tables that are made within it go at its end, but for those whose path was made before; so do the shuffle files of each query.

    Tables are compressed by zstd, which halves ids in hex digits.
    """
    codec, own = "spark.sql.parquet.compression.codec", table_path(spark, "steps")
    old = {k: spark.conf.get(k, None) for k in (_STEPS, codec)}
    spark.conf.set(_STEPS, own)
    spark.conf.set(codec, "zstd")
    try:
        with released(spark):
            yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
        discard(spark, own)


def written(df: DataFrame, name: str, path: str | None = None, by: str | None = None, values: int = 0) -> DataFrame:
    """``df`` written to a new table in the shared folder and read again, which cuts its lineage.

    by: a column of so many values, each of which is a folder; rows are not sorted for it.
    """
    spark, path, writers = df.sparkSession, path or table_path(df.sparkSession, name), "spark.sql.maxConcurrentOutputFileWriters"
    if by is None:
        df.write.parquet(path)
    else:
        old = spark.conf.get(writers, None)
        spark.conf.set(writers, str(values))
        try:
            df.write.partitionBy(by).parquet(path)
        finally:
            spark.conf.set(writers, old) if old else spark.conf.unset(writers)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table; what was read from it can't be read again."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this application, once its results are written elsewhere."""
    discard(spark, session_dir(spark))
