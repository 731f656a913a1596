"""Chains of anchors over ranges of one key's times.

An anchor's next is the first event at least so far beyond it.  Which events of
a range are anchors depends on the last anchor before it, but only by the event
that the chain enters the range with; so a range is a function from the anchor
that comes in to the one that goes out, a step for each event that it may be
entered with, and far fewer where chains have met.  Such functions compose:
every range doubles the ranges that its function spans until it begins where
the anchor is known, in as many rounds as the number of ranges has digits.
Within a range, chains are followed by doubling, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewatch.shared import discard, table_path, written

#: ``from_``: the range whose outgoing anchor comes in, or null; ``out``: what goes out, where it is known; else by steps.
SUMMARY = "range_ long, from_ long, out long, steps binary, outs binary, entered long"


def lasts(times: np.ndarray, reach: int) -> np.ndarray:
    """For each of the sorted times, the last anchor of the chain that begins with it."""
    after = np.searchsorted(times, times + reach)
    to = np.where(after < len(times), after, np.arange(len(times)))
    while (to[to] != to).any():
        to = to[to]
    return times[to]


def sparse(times: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function without steps that change nothing: of equal outs the last time."""
    kept = np.ones(len(times), bool)
    kept[:-1] = outs[1:] != outs[:-1]
    return times[kept], outs[kept]


def applied(times: np.ndarray, outs: np.ndarray, anchor: np.ndarray, reach: int) -> np.ndarray:
    """What goes out for anchors that come in; an anchor that reaches beyond the range goes on."""
    at = np.searchsorted(times, anchor + reach)
    return np.where(at < len(times), outs[np.minimum(at, len(times) - 1)], anchor)


def composed(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    times, outs = first
    beyond = then[0] > times[-1]
    return sparse(np.concatenate([times, then[0][beyond]]), np.concatenate([applied(*then, outs, reach), then[1][beyond]]))


def summary(reach: int) -> Callable[[pa.Table], pa.Table]:
    """Of a range's events (``key_``, ``us``; ``first_``, ``last_``, ``from_`` and ``goes_on`` of the range)."""

    def each(rows: pa.Table) -> pa.Table:
        place, before, first, last, goes_on = (rows.column(c)[0].as_py() for c in ("range_", "from_", "first_", "last_", "goes_on"))
        key, us = np.asarray(rows.column("key_")), rows.column("us").to_numpy()
        own = np.unique(us[key == last])
        outs = lasts(own, reach)
        out = None if first == last and goes_on else int(outs[0])
        steps = sparse(own, outs) if out is None else (np.empty(0, np.int64),) * 2
        return pa.Table.from_pylist([{"range_": place, "from_": before if goes_on else None, "out": out, "steps": steps[0].tobytes(), "outs": steps[1].tobytes(), "entered": before if goes_on else None}], _schema())

    return each


def _schema() -> pa.Schema:
    return pa.schema([("range_", pa.int64()), ("from_", pa.int64()), ("out", pa.int64()), ("steps", pa.binary()), ("outs", pa.binary()), ("entered", pa.int64())])


def _doubled(reach: int):
    array = lambda x: np.frombuffer(x.as_buffer(), np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                plain = {c: row[c].as_py() for c in ("range_", "from_", "out", "entered", "q_from", "q_out")}
                made = {c: plain[c] for c in ("range_", "from_", "out", "entered")} | {"steps": b"", "outs": b""}
                if plain["out"] is None:
                    own = array(row["steps"]), array(row["outs"])
                    if plain["q_out"] is not None:
                        made |= {"out": int(applied(*own, np.array([plain["q_out"]]), reach)[0])}
                    else:
                        steps, outs = composed((array(row["q_steps"]), array(row["q_outs"])), own, reach)
                        made |= {"from_": plain["q_from"], "steps": steps.tobytes(), "outs": outs.tobytes()}
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, _schema())

    return each


def resolved(summaries: DataFrame, reach: int) -> DataFrame:
    """``range_`` and ``anchor``, the one that comes in, of each range that a key goes on into."""
    spark = summaries.sparkSession
    path = table_path(spark, "chains")
    now = written(summaries, "chains", path)
    while not now.where("out is null").isEmpty():
        q = now.select(F.col("range_").alias("q"), F.col("from_").alias("q_from"), F.col("out").alias("q_out"), F.col("steps").alias("q_steps"), F.col("outs").alias("q_outs"))
        open_ = now.where("out is null").join(q, F.col("from_") == F.col("q")).drop("q")
        last, path = path, table_path(spark, "chains")
        now = written(now.where("out is not null").unionByName(open_.mapInArrow(_doubled(reach), SUMMARY)), "chains", path)
        discard(spark, last)
    outs = now.select(F.col("range_").alias("entered"), F.col("out").alias("anchor"))
    return now.select("range_", "entered").join(outs, "entered").select("range_", "anchor")


def folded(reach: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A range's events with ``forwarded`` and ``anchor_us``, from the anchor that comes in under its first key."""

    def each(rows: pa.Table, incoming: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["range_"]).sort_by([("key_", "ascending"), ("us", "ascending"), ("event_id", "ascending")])
        key, us = np.asarray(rows.column("key_")), rows.column("us").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        anchors, passed = np.empty(len(us), np.int64), np.zeros(len(us), bool)
        for i, (low, high) in enumerate(zip(begin, [*begin[1:], len(us)], strict=True)):
            at, now = low, None
            if i == 0 and incoming.num_rows:
                now = incoming.column("anchor")[0].as_py()
                at = low + int(np.searchsorted(us[low:high], now + reach))
                anchors[low:at] = now
            while at < high:
                end = low + int(np.searchsorted(us[low:high], us[at] + reach))
                passed[at] = True
                anchors[at:end] = us[at]
                at = end
        return rows.append_column("forwarded", pa.array(passed)).append_column("anchor_us", pa.array(anchors))

    return each
