"""Running values under a key in order, also where one key has most of the rows.

A window takes all rows of a key in one task.  Where a key has too many for
that, rows are dealt by ranges of key and order, so that a key's rows are many
tasks; each task scans its own in order, what a range ends with is carried into
those after it by a prefix scan over the ranges, and the rows at their begin are
mended.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.shared import written

ORDER = ("us", "event_id")
#: Rows of a key up to which a window takes them in one task.
LARGEST = 2_000_000


@dataclass(frozen=True)
class Running:
    """``last``: the last value that isn't null; ``total``: the sum, null being 0.  ``before``: of the rows before, without the row's own."""

    kind: str
    column: Column
    before: bool = False


def last(column: Column, before: bool = False) -> Running:
    return Running("last", column, before)


def total(column: Column, before: bool = False) -> Running:
    return Running("total", column.cast("long"), before)


def running(events: DataFrame, keys: Sequence[str], values: dict[str, Running], order: Sequence[str] = ORDER, reverse: bool = False) -> DataFrame:
    """Adds the values by name.  Rows under one key (null is one too) go by ``order``, ascending with nulls first, or the reverse.

    The order's columns tell a key's rows apart; without keys all rows are one sequence.
    """
    most = events.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return (_dealt if most > LARGEST else _windows)(events, keys, values, order, reverse)


def _sorted(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.desc_nulls_last(c) if reverse else F.asc_nulls_first(c) for c in order]


def _windows(events: DataFrame, keys: Sequence[str], values: dict[str, Running], order: Sequence[str], reverse: bool) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(*_sorted(order, reverse))
    upto = {before: over.rowsBetween(Window.unboundedPreceding, -1 if before else 0) for before in (False, True)}
    return events.withColumns({n: F.last(v.column, True).over(upto[v.before]) if v.kind == "last" else F.coalesce(F.sum(v.column).over(upto[v.before]), F.lit(0)) for n, v in values.items()})


def _last(values: pa.Array, start: np.ndarray, before: bool, carry: pa.Array, carried: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Running last values; ``start``: where each row's key begins in the batch; ``carry`` counts for the rows ``carried``; and the carry from here."""
    n = len(values)
    at = np.where(np.asarray(values.is_valid()), np.arange(n), -1)
    at = np.maximum.accumulate(at)
    everything = pa.concat_arrays([values, carry])
    upto = np.where(at >= start, at, np.where(carried, n, -1))
    if before:
        earlier = np.concatenate([[-1], at[:-1]])
        shown = np.where(earlier >= start, earlier, np.where(carried, n, -1))
    else:
        shown = upto
    take = lambda i: everything.take(pa.array(np.maximum(i, 0), mask=i < 0))
    return take(shown), take(upto[-1:])


def _total(values: pa.Array, start: np.ndarray, before: bool, carry: pa.Array, carried: np.ndarray) -> tuple[pa.Array, pa.Array]:
    own = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(own)])
    upto = sums[1:] - sums[start] + np.where(carried, carry[0].as_py() or 0, 0)
    return pa.array(upto - own if before else upto), pa.array(upto[-1:])


def _dealt(events: DataFrame, keys: Sequence[str], values: dict[str, Running], order: Sequence[str], reverse: bool) -> DataFrame:
    spark = events.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))) if keys else F.lit("")
    own = events.withColumns({"key_": key} | {f"value_{i}": v.column for i, v in enumerate(values.values())})
    by = [F.asc("key_"), *_sorted(order, reverse)]
    dealt = own.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    kinds = [(v.kind, v.before) for v in values.values()]
    types = [own.schema[f"value_{i}"].dataType.simpleString() for i in range(len(kinds))]
    more = ", ".join(["range_ long, place_ long, head_ boolean", *(f"shown_{i} {t}, ends_{i} {t}" for i, t in enumerate(types))])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop(*(f"value_{i}" for i in range(len(kinds)))).schema.fields), more])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen, first, now, carry = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column("key_")
            new = np.ones(n, bool)
            new[1:] = np.asarray(pc.not_equal(key.slice(1), key.slice(0, n - 1)))
            new[0] = key[0].as_py() != now
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            carried = np.cumsum(new) == 0
            first = key[0].as_py() if first is None else first
            out, carry_to = [], []
            for i, (kind, before) in enumerate(kinds):
                column = batch.column(f"value_{i}")
                shown, end = (_last if kind == "last" else _total)(column, start, before, carry[i] if carry else pa.nulls(1, column.type), carried)
                # What the range ends with is told by its last row alone; it is the batch's, until another comes.
                out += [shown, pa.concat_arrays([pa.nulls(n - 1, end.type), end])]
                carry_to.append(end)
            carry, now = carry_to, key[n - 1].as_py()
            kept = [c for c in batch.schema.names if not c.startswith("value_")]
            head = pc.equal(key, first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.full(n, here)), pa.array(np.arange(seen, seen + n)), head, *out], names=[*kept, "range_", "place_", "head_", *(f"{x}_{i}" for i in range(len(kinds)) for x in ("shown", "ends"))])
            seen += n

    scanned = written(dealt.mapInArrow(scan, schema), "scanned")
    ends = F.struct(*(f"ends_{i}" for i in range(len(kinds))), F.lit(True).alias("there_"))
    # A row for each range; there are as many as tasks.
    of_range = scanned.groupBy("range_").agg(F.min("key_").alias("first_"), F.max("key_").alias("last_"), F.max_by(ends, "place_").alias("e"))
    upto = Window.partitionBy("last_").orderBy("range_").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(F.col(f"e.ends_{i}"), True).over(upto) if kind == "last" else F.sum(F.col(f"e.ends_{i}")).over(upto) for i, (kind, _) in enumerate(kinds)]
    chained = of_range.select("range_", "first_", "last_", *(c.alias(f"carry_{i}") for i, c in enumerate(carried)))
    # The range before a range, if its last key goes on; the ranges' numbers are dense but for empty ones.
    step = Window.orderBy("range_")
    goes_on = F.lag("last_").over(step) == F.col("first_")
    into = chained.select("range_", *(F.when(goes_on, F.lag(f"carry_{i}").over(step)).alias(f"carry_{i}") for i in range(len(kinds))))
    joined = scanned.join(F.broadcast(into), "range_")
    mended = []
    for i, (n, v) in enumerate(values.items()):
        carry = F.when(F.col("head_"), F.col(f"carry_{i}"))
        mended.append((F.coalesce(f"shown_{i}", carry) if v.kind == "last" else F.col(f"shown_{i}") + F.coalesce(carry, F.lit(0))).alias(n))
    return joined.select(*(c for c in events.columns if c not in values), *mended)
