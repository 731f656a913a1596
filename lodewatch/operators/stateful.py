"""Operators whose outcome depends on what came before under the same key."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.operators import chains, scan
from lodewatch.operators.scan import last, running, total
from lodewatch.shared import written

State = tuple[int, int]
#: Events in a range of a hot key, about.
RANGE = 1_000_000


def step(state: State | None, us: int, reach_us: int) -> tuple[State, bool]:
    """One event under a key: the new state (anchor, events since) and whether the event is forwarded.

    An event nearer than ``reach_us`` to the anchor is absorbed; any other is
    forwarded and becomes the anchor.  Shared with the streaming form.
    """
    if state is not None and us - state[0] < reach_us:
        return (state[0], state[1] + 1), False
    return (us, 1), True


def anchored(events: DataFrame, keys: Sequence[str], reach_us: int) -> DataFrame:
    """Adds ``forwarded``, ``anchor_us`` and ``nth`` (place in the anchor's window) by ``us`` and ``event_id``.

    Anchors follow from the ones before, so each key is folded in order, by one
    state over sorted partitions.  Where a key has more than ``scan.LARGEST``
    events, it is cut into ranges of time, which are folded at once: see
    ``chains``.  Events without a time are forwarded and change nothing.
    """
    own = events.withColumn("key_", F.to_json(F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))))
    counted = own.groupBy("key_").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if reach_us > 0 and (counted.most or 0) > scan.LARGEST:
        return _in_ranges(own, reach_us, counted["all"]).drop("key_")
    sorted_ = own.repartition("key_").sortWithinPartitions("key_", F.asc_nulls_first("us"), "event_id")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields), "forwarded boolean, anchor_us long, nth long"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            kept, anchors, nth = [], [], []
            for key, us in zip(batch.column("key_").to_pylist(), batch.column("us").to_pylist(), strict=True):
                if key != last:
                    last, state = key, None
                if us is None:
                    kept.append(True), anchors.append(None), nth.append(1)
                    continue
                state, passed = step(state, us, reach_us)
                kept.append(passed), anchors.append(state[0]), nth.append(state[1])
            more = [pa.array(kept, pa.bool_()), pa.array(anchors, pa.int64()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "forwarded", "anchor_us", "nth"])

    return sorted_.mapInArrow(fold, schema).drop("key_")


def _in_ranges(own: DataFrame, reach_us: int, rows: int) -> DataFrame:
    """``anchored`` over ranges of keys and times of bounded size, each folded from the anchor that it is come to with."""
    ranges = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE))
    dealt = written(own.repartitionByRange(ranges, "key_", F.asc_nulls_first("us"), "event_id").withColumn("range_", F.spark_partition_id().cast("long")), "ranges")
    timed = dealt.where("us is not null")
    ends = timed.groupBy("range_").agg(F.min("key_").alias("first_"), F.max("key_").alias("last_"))
    step_ = Window.orderBy("range_")  # a row for each range
    ends = ends.select("*", F.lag("range_").over(step_).alias("from_"), (F.lag("last_").over(step_) == F.col("first_")).alias("goes_on"))
    known = F.broadcast(ends.select("range_", "first_", "last_", "from_", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    summaries = timed.select("range_", "key_", "us").join(known, "range_").groupBy("range_").applyInArrow(chains.summary(reach_us), chains.SUMMARY)
    incoming = chains.resolved(summaries, reach_us)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields), "forwarded boolean, anchor_us long"])
    folded = timed.groupBy("range_").cogroup(incoming.groupBy("range_")).applyInArrow(chains.folded(reach_us), schema)
    counted = running(folded, ["key_", "anchor_us"], {"nth": total(F.lit(1))})
    return counted.unionByName(dealt.where("us is null").drop("range_").withColumns({"forwarded": F.lit(True), "anchor_us": F.lit(None).cast("long"), "nth": F.lit(1).cast("long")}))


def dedup_decisions(events: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """FORWARD or COMPRESS; elapsed time counts in whole seconds, so a window of w ends before w + 1."""
    return anchored(events, keys, (window + 1) * 1_000_000).withColumn("decision", F.when(F.col("forwarded"), "FORWARD").otherwise("COMPRESS"))


def compress_summaries(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows in which something was absorbed."""
    return decisions.groupBy(*keys, "anchor_us").agg(F.max("nth").alias("repeat_count"), F.max("us").alias("last_us")).where("repeat_count >= 2")


def suppressed(events: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """T4: events at least so long after the last accepted one."""
    return anchored(events, keys, seconds * 1_000_000).where("forwarded")


def first_seen(events: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ("us", "event_id")) -> DataFrame:
    """Adds ``novel``, true at the first event of each key.

    The order's columns tell a key's events apart; of events that are equal in
    all of them, all are first.  Firsts are aggregated and joined back, so that
    a key that most events have is no one task's.  Missing keys are a key.
    """
    firsts = events.groupBy(*(F.col(k).alias(f"first_{i}") for i, k in enumerate(keys))).agg(F.min(F.struct(*order)).alias("first_at"))
    same = functools.reduce(lambda x, y: x & y, (events[k].eqNullSafe(F.col(f"first_{i}")) for i, k in enumerate(keys)))
    joined = events.join(firsts, same)
    return joined.select(*(events[c] for c in events.columns), (F.struct(*order) == F.col("first_at")).alias("novel"))


def first_of(events: DataFrame, keys: Sequence[str], order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """The first event of each key."""
    return first_seen(events, keys, order).where("novel").drop("novel")


def unseen(events: DataFrame, keys: Sequence[str], seen: DataFrame, order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """T3 against what is kept from earlier runs (``seen``: the keys): ``novel`` at the first event of a key that isn't in it."""
    known = seen.select(*(F.col(k).alias(f"seen_{i}") for i, k in enumerate(keys))).distinct().withColumn("known_", F.lit(True))
    flagged = first_seen(events, keys, order)
    same = functools.reduce(lambda x, y: x & y, (flagged[k].eqNullSafe(F.col(f"seen_{i}")) for i, k in enumerate(keys)))
    joined = flagged.join(known, same, "left")
    return joined.select(*events.columns, (F.col("novel") & F.col("known_").isNull()).alias("novel"))


def latest(events: DataFrame, states: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """As-of join: adds the ``values`` of the last state of the key at or before each event; null without one.

    states: the keys, ``us``, the values, which the events don't have.  Both
    sides go into one order, so that the join is a running last value; of
    states at one time, the greatest counts.
    """
    marked = states.select(*keys, "us", F.struct(*values).alias("state_"), F.lit(0).alias("side_"))
    own = events.withColumns({"state_": F.lit(None).cast(marked.schema["state_"].dataType), "side_": F.lit(1)})
    found = running(own.unionByName(marked, allowMissingColumns=True), keys, {"found_": last(F.col("state_"))}, ("us", "side_", "state_")).where("side_ = 1")
    return found.select(*events.columns, *(F.col(f"found_.{v}").alias(v) for v in values))


def sessions(events: DataFrame, keys: Sequence[str], gap_s: int) -> DataFrame:
    """Adds ``session``: a number that rises wherever a key is idle for longer than the gap."""
    timed = running(events, keys, {"before_": last(F.col("us"), before=True)})
    return running(timed, keys, {"session": total(F.col("us") - F.col("before_") > gap_s * 1_000_000)}).drop("before_")
