"""Streaming forms: the same steps as the batch operators, with state kept by Spark.

Within a micro-batch a key's events are taken in time order.  What a timer ends
is ended once the watermark has passed it; state goes with it, so its size
follows the keys that are active and not all that ever were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodewatch.functions.tables import STALE_WRITE
from lodewatch.operators.stateful import step

#: What a step makes of a state and a row (None: the timer has come): the new state (None: forget), rows out, time of the timer in microseconds.
Step = Callable[[tuple | None, object | None], tuple[tuple | None, list[tuple], int | None]]


def folded_stream(events: DataFrame, key: str, each: Step, state: str, out: str, watermark: str) -> DataFrame:
    """Folds the events (``us``, ``event_id``, ``ts``) of each key by ``each``; out: schema of what it makes, after the key."""
    names = [f.split()[0] for f in out.split(", ")]

    def fold(k: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(kept.get) if kept.exists else None
        made, timer = [], None
        if kept.hasTimedOut:
            now, made, timer = each(now, None)
        else:
            for row in pd.concat(list(parts)).sort_values(["us", "event_id"]).itertuples():
                now, more, timer = each(now, row)
                made += more
        if now is None:
            kept.remove()
        else:
            kept.update(now)
            kept.setTimeoutTimestamp(max(timer // 1000, kept.getCurrentWatermarkMs() + 1))
        if made:
            yield pd.DataFrame([(k[0], *m) for m in made], columns=[key, *names])

    keyed = events.withColumn(key, F.col(key).cast("string")).withWatermark("ts", watermark)
    return keyed.groupBy(key).applyInPandasWithState(fold, f"{key} string, {out}", state, "append", GroupStateTimeout.EventTimeTimeout)


def anchored_stream(events: DataFrame, key: str, reach_us: int, watermark: str = "60 seconds", idle_ms: int = 600_000) -> DataFrame:
    """T1, T4 on a stream of ``event_id``, ``ts``, ``us`` and the key: adds ``forwarded``, ``anchor_us``, ``nth``.

    State that is idle for ``idle_ms`` beyond the anchor's reach is dropped.
    """

    def each(now: tuple | None, row: object | None) -> tuple[tuple | None, list[tuple], int | None]:
        if row is None:
            return None, [], None
        now, passed = step(now, int(row.us), reach_us)
        return now, [(row.event_id, int(row.us), passed, *now)], now[0] + reach_us + idle_ms * 1000

    kind = events.schema["event_id"].dataType.simpleString()
    return folded_stream(events, key, each, "anchor_us long, nth long", f"event_id {kind}, us long, forwarded boolean, anchor_us long, nth long", watermark)


def summary_stream(events: DataFrame, key: str, reach_us: int, watermark: str = "60 seconds") -> DataFrame:
    """Windows that absorbed something, with ``repeat_count`` and ``last_us``, once they are over."""

    def closed(now: tuple | None) -> list[tuple]:
        return [now] if now and now[1] >= 2 else []

    def each(now: tuple | None, row: object | None) -> tuple[tuple | None, list[tuple], int | None]:
        if row is None:
            return None, closed(now), None
        us = int(row.us)
        state, passed = step(now[:2] if now else None, us, reach_us)
        return (*state, us), closed(now) if passed else [], state[0] + reach_us

    return folded_stream(events, key, each, "anchor_us long, n long, last_us long", "anchor_us long, repeat_count long, last_us long", watermark)


def coalesced_stream(events: DataFrame, key: str = "file_key", stale_s: int = STALE_WRITE, watermark: str = "60 seconds") -> DataFrame:
    """One row for the writes of a key up to its close or idle time; deleted ones are dropped. events: ``action``."""
    stale = stale_s * 1_000_000

    def each(now: tuple | None, row: object | None) -> tuple[tuple | None, list[tuple], int | None]:
        made = []
        if now and (row is None or (row.action == "write" and int(row.us) - now[2] > stale)):
            now, made = None, [(*now, "stale")]
        if row is not None and row.action == "write":
            us = int(row.us)
            now = (now[0] + 1, now[1], us) if now else (1, us, us)
        elif row is not None and row.action in ("close", "delete"):
            if now and row.action == "close":
                made.append((*now, "close"))
            now = None
        return now, made, now[2] + stale if now else None

    return folded_stream(events, key, each, "n long, first_us long, last_us long", "write_count long, first_us long, last_us long, flushed_by string", watermark)


def temp_stream(events: DataFrame, key: str, reason: Callable[[tuple, object], str | None], deep_s: int, watermark: str = "60 seconds") -> DataFrame:
    """The state of each temporary file (``key``) when it changes: WATCHING, ELEVATED with its reason, DROPPED.

    reason: from (born, creator) and a row, why the file is elevated, or None.
    A file that outlives ``deep_s`` unseen is elevated by the timer.
    """

    def each(now: tuple | None, row: object | None) -> tuple[tuple | None, list[tuple], int | None]:
        if row is None:
            if now[2] == "WATCHING":
                return None, [(now[0] + deep_s * 1_000_000, "ELEVATED", "long_lived_temp_file")], None
            return None, [], None
        us, made = int(row.us), []
        if now is None:
            now, made = (us, int(row.pid), "WATCHING"), [(us, "WATCHING", None)]
        elif now[2] == "DROPPED" and row.action != "delete":
            now, made = (*now[:2], "WATCHING"), [(us, "WATCHING", None)]
        why = reason(now, row) if now[2] != "ELEVATED" else None
        if why:
            now, made = (*now[:2], "ELEVATED"), [*made, (us, "ELEVATED", why)]
        elif row.action == "delete" and now[2] == "WATCHING":
            now, made = (*now[:2], "DROPPED"), [*made, (us, "DROPPED", None)]
        return now, made, max(us, now[0] + deep_s * 1_000_000)

    return folded_stream(events, key, each, "born long, creator long, state string", "us long, state string, reason string", watermark)


def device_stream(events: DataFrame, key: str = "device", most_s: int = 7 * 86400, watermark: str = "60 seconds") -> DataFrame:
    """A row for each device session at its removal, or ``most_s`` after its last event.

    events: ``kind`` (arrival, removal, or an operation), ``size``.  Rows
    outside a session are dropped.
    """
    operations = ("read", "write", "delete", "execute")

    def each(now: tuple | None, row: object | None) -> tuple[tuple | None, list[tuple], int | None]:
        if row is None:
            return None, [(*now, False)], None
        us = int(row.us)
        if now is None:
            now = (us, us, 0, 0, 0, 0, 0, 0) if row.kind == "arrival" else None
        elif row.kind == "removal":
            return None, [(now[0], us, *now[2:], True)], None
        else:
            count = [n + (row.kind == o) for n, o in zip(now[2:6], operations, strict=True)]
            size = [n + (int(row.size) if row.kind == o else 0) for n, o in zip(now[6:], operations[:2], strict=True)]
            now = (now[0], us, *count, *size)
        return now, [], now[1] + most_s * 1_000_000 if now else None

    fields = "start_us long, end_us long, reads long, writes long, deletes long, executes long, bytes_read long, bytes_written long"
    return folded_stream(events, key, each, fields, f"{fields}, removed boolean", watermark)


def novel_stream(events: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's reach."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def churn_stream(events: DataFrame, key: str, width: str = "1 second", watermark: str = "5 seconds") -> DataFrame:
    """A12 on a stream: events of each folder in tumbling windows."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def flow_stream(events: DataFrame, keys: list[str], idle: str = "300 seconds", watermark: str = "60 seconds") -> DataFrame:
    """A7, T9 on a stream: a flow ends when it has been idle for so long."""
    by = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("bytes"))), F.lit(0))
    grouped = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", idle).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("packets"), by("OUTBOUND").alias("bytes_sent"), by("INBOUND").alias("bytes_recv")).select(*keys, F.col("w.start").alias("first_seen"), F.col("w.end").alias("closed_at"), "packets", "bytes_sent", "bytes_recv")
