"""Counters that come with the work itself, without another pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def decision_counts() -> dict[str, Column]:
    """Of rows with ``forwarded``: all, forwarded and compressed ones."""
    return {"total": F.count(F.lit(1)), "forwarded": F.count_if("forwarded"), "compressed": F.count_if(~F.col("forwarded"))}


def script_counts() -> dict[str, Column]:
    """Of script log rows (``severity`` as a number, ``is_dedup``): all, first ones, and those of each higher severity."""
    return {"scripts": F.count(F.lit(1)), "unique": F.count_if(~F.col("is_dedup")), "high": F.count_if(F.col("severity") == 4), "critical": F.count_if(F.col("severity") >= 5)}


def counted(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows as they are, and what will hold the counters once they have been written or collected, once: ``.get``."""
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in counters.items())), seen


def counted_stream(stream: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
    """A stream that reports the counters of each micro-batch in its progress, under ``name``."""
    return stream.observe(name, *(c.alias(n) for n, c in counters.items()))


def totals(query: StreamingQuery, name: str) -> dict[str, int]:
    """The sums of a stream's counters over the micro-batches that its progress holds."""
    out: dict[str, int] = {}
    for progress in query.recentProgress:
        row = (progress.observedMetrics or {}).get(name)
        for k, v in (row.asDict() if row else {}).items():
            out[k] = out.get(k, 0) + v
    return out
