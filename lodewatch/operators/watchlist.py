"""The watchlist, a small table of application names and the ids of their running processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value. Names that a list holds.
MOST = 20


def watchlist(spark: SparkSession, names: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """A list of these names: lower case, each once, in their order."""
    kept = list(dict.fromkeys(n.strip().lower() for n in names if n and n.strip()))
    if len(kept) > MOST:
        raise ValueError(f"a watchlist has {MOST} names at most")
    return spark.createDataFrame([(i, n) for i, n in enumerate(kept)], "place int, app_name string")


def names(listed: DataFrame) -> list[str]:
    return [r.app_name for r in listed.orderBy("place").collect()]


def added(listed: DataFrame, name: str) -> DataFrame:
    return watchlist(listed.sparkSession, [*names(listed), name])


def removed(listed: DataFrame, name: str) -> DataFrame:
    return watchlist(listed.sparkSession, [n for n in names(listed) if n != name.strip().lower()])


def running(listed: DataFrame, processes: DataFrame) -> DataFrame:
    """Each name with the ids of its live processes (``process_name``, ``pid``) and whether it has any."""
    live = processes.groupBy(F.lower("process_name").alias("app_name")).agg(F.array_sort(F.collect_set("pid")).alias("pids"))
    return listed.join(live, "app_name", "left").select("app_name", F.coalesce("pids", F.array().cast("array<bigint>")).alias("pids"), F.col("pids").isNotNull().alias("active"))
