"""Shared-folder tables and small helpers that every operator here uses.

Executors may vanish at any time and share no local folder with the driver, so
whatever an operator keeps between jobs is a Parquet table in the folder named
by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch import shared

#: Stands for a missing grouping value; no language or source is called this.
NO_VALUE = "\x00"


#: Tables made within ``scratch``, and whether one is open.
_scratch: list[str] = []
_open = False


def written(df: DataFrame, name: str, **how: str | int | None) -> DataFrame:
    """``shared.written``, which ``scratch`` keeps account of."""
    out = shared.written(df, name, **how)
    if _open:
        _scratch.extend({f.rsplit("/", 1)[0] for f in out.inputFiles()})
    return out


@contextmanager
def scratch(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """For a stage whose result is written before the next stage is called.

    Deletes the tables that the stages before left in the shared folder, and
    lets Spark drop their shuffle files, unless ``docs`` still reads from them.
    """
    global _open
    if _scratch and not set(_scratch) & {f.rsplit("/", 1)[0] for f in docs.inputFiles()}:
        jvm = spark.sparkContext._jvm
        for path in _scratch:
            to = jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
        _scratch.clear()
        gc.collect()
        jvm.System.gc()
    _open = True
    try:
        yield
    finally:
        _open = False


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def group_key(name: str) -> Column:
    """A grouping column without nulls."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NO_VALUE))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` (long) and ``text`` (null: empty) alone; no other column of ``df`` gets in the way."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
