"""Streams with tables under each key: buckets of temporary files, and a flow table of bounded size.

State is a map in Spark's state store, of which a micro-batch reads a key's
entries once and writes back what changed.  What is idle is ended by event-time
timers; a key has one timer, for the first of its entries to end.  Such streams
need the store that ``store`` names, set before they start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lodewatch.functions.tables import TEMP_IDLE

#: Flows that a table holds, and seconds after which one is idle.
MOST_FLOWS, FLOW_IDLE = 50_000, 300


def store(spark: SparkSession) -> None:
    """Sets the state store that maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], names: Sequence[str]) -> Iterator[tuple]:
    """The micro-batch's rows of a key in time order, by columns and not by rows of Python objects; what they are is bounded by the micro-batch."""
    parts = [r[["us", "event_id", *names]] for r in rows]
    held = pd.concat(parts, ignore_index=True).sort_values(["us", "event_id"], kind="stable")
    return zip(*(held[n].tolist() for n in ("us", *names)), strict=True)


class _Timed(StatefulProcessor):
    """One timer a key, kept in the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def set_timer(self, at: int | None, timers: TimerValues) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        at = None if at is None else max(at, timers.getCurrentWatermarkInMs() + 1)
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            if at is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def close(self) -> None:
        pass


class Buckets(_Timed):
    """Under a key: totals, and the files that are alive, each with whether it is elevated."""

    totals = "created long, deleted long, elevated long, first_us long, last_us long"

    def __init__(self, keys: Sequence[str], idle_s: int) -> None:
        self.keys, self.idle = list(keys), idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now, self.files = handle.getValueState("totals", self.totals), handle.getMapState("files", "path string", "elevated boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        """A row for each living file, with the totals of its bucket."""
        for path, up in zip(initialState["path"], initialState["file_elevated"], strict=True):
            self.files.updateValue((path,), (bool(up),))
        now = tuple(int(initialState[c.split()[0]].iloc[0]) for c in self.totals.split(", "))
        self.now.update(now)
        self.set_timer((now[4] + self.idle) // 1000, timerValues)

    def _rows(self, key: tuple, ended: list[tuple]) -> Iterator[pd.DataFrame]:
        if ended:
            yield pd.DataFrame([(*key, *e) for e in ended], columns=[*self.keys, *(c.split()[0] for c in self.totals.split(", ")), "ended_by"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = self.now.get() if self.now.exists() else None
        before = {k[0]: v[0] for k, v in self.files.iterator()}
        files, ended = dict(before), []
        for us, path, action, elevated in _in_order(rows, ("path", "action", "elevated")):
            if now and us - now[4] > self.idle:
                ended.append((*now, "idle"))
                now, files = None, {}
            created, deleted, up, first, _ = now or (0, 0, 0, us, us)
            if path not in files:
                created, files[path] = created + 1, False
            if elevated and not files[path]:
                up, files[path] = up + 1, True
            if action == "delete":
                deleted = deleted + 1
                del files[path]
            now = (created, deleted, up, first, us)
            if not files:
                ended.append((*now, "empty"))
                now = None
        for path in before.keys() - files.keys():
            self.files.removeKey((path,))
        for path, up in files.items():
            if before.get(path) is not up:
                self.files.updateValue((path,), (up,))
        if now:
            self.now.update(now)
        else:
            self.now.clear()
        self.set_timer((now[4] + self.idle) // 1000 if now else None, timerValues)
        yield from self._rows(key, ended)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.now.get() if self.now.exists() else None
        self.now.clear(), self.files.clear(), self.timer.clear()
        yield from self._rows(key, [(*now, "idle")] if now else [])


def bucket_stream(events: DataFrame, keys: Sequence[str] = ("directory", "pid"), idle_s: int = TEMP_IDLE, watermark: str = "60 seconds", initial: DataFrame | None = None) -> DataFrame:
    """A11, L8, T7 on a stream: a row for each bucket of temporary files once none of them is alive or it has been idle, and ``ended_by``.

    events: the keys, ``event_id``, ``us``, ``ts``, ``path``, ``action``,
    ``elevated``.  initial: open buckets of an earlier run, a row for each living
    file: the keys, ``path``, ``file_elevated`` and the totals.
    """
    kinds = [f"{k} {events.schema[k].dataType.simpleString()}" for k in keys]
    grouped = events.select(*keys, "event_id", "us", "ts", "path", "action", "elevated").withWatermark("ts", watermark).groupBy(*keys)
    schema = ", ".join([*kinds, Buckets.totals, "ended_by string"])
    return grouped.transformWithStateInPandas(Buckets(keys, idle_s), schema, "append", "eventTime", initialState=None if initial is None else initial.groupBy(*keys))


class Flows(_Timed):
    """Under a key, a table of flows: first and last time, packets, bytes by direction and the last state."""

    entry = "first_us long, last_us long, packets long, bytes_sent long, bytes_recv long, last_state string"

    def __init__(self, table: str, keys: Sequence[str], idle_s: int, most: int) -> None:
        self.table, self.keys, self.idle, self.most = table, list(keys), idle_s * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.flows = handle.getMapState("flows", ", ".join(f"{k} string" for k in self.keys), self.entry)

    def _rows(self, key: tuple, ended: list[tuple]) -> Iterator[pd.DataFrame]:
        if ended:
            yield pd.DataFrame([(key[0], *e) for e in ended], columns=[self.table, *self.keys, *(c.split()[0] for c in self.entry.split(", ")), "ended_by"])

    def _oldest_first(self) -> dict[tuple, tuple]:
        return dict(sorted(((tuple(k), tuple(v)) for k, v in self.flows.iterator()), key=lambda x: (x[1][1], x[0])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        flows, ended, changed = self._oldest_first(), [], set()
        for us, direction, state, size, *flow in _in_order(rows, ("direction", "tcp_state", "bytes", *self.keys)):
            flow = tuple(flow)
            old = flows.pop(flow, None)
            if old and us - old[1] > self.idle:
                ended.append((*flow, *old, "idle"))
                old = None
            if old is None and len(flows) >= self.most:
                gone = next(iter(flows))  # in the order of last times
                left = flows.pop(gone)
                ended.append((*gone, *left, "idle" if us - left[1] > self.idle else "capacity"))
                changed.add(gone)
            first, _, packets, sent, received, _ = old or (us, us, 0, 0, 0, "")
            sent, received = (sent + size, received) if direction == "OUTBOUND" else (sent, received + size)
            flows[flow] = (first, us, packets + 1, sent, received, state)
            changed.add(flow)
        for flow in changed:
            if flow in flows:
                self.flows.updateValue(flow, flows[flow])
            elif self.flows.containsKey(flow):
                self.flows.removeKey(flow)
        first = next(iter(flows.values()))
        self.set_timer((first[1] + self.idle) // 1000, timerValues)
        yield from self._rows(key, ended)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        flows, ended = self._oldest_first(), []
        for flow, (first, last, *more) in list(flows.items()):
            if (last + self.idle) // 1000 > timerValues.getCurrentWatermarkInMs():
                break
            ended.append((*flow, first, last, *more, "idle"))
            self.flows.removeKey(flow)
            del flows[flow]
        if flows:
            self.set_timer((next(iter(flows.values()))[1] + self.idle) // 1000, timerValues)
        yield from self._rows(key, ended)


def flow_table_stream(events: DataFrame, table: str, keys: Sequence[str] = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol"), idle_s: int = FLOW_IDLE, most: int = MOST_FLOWS, watermark: str = "60 seconds") -> DataFrame:
    """T9 on a stream: flows when they end, with their last state and ``ended_by``: idle, or capacity.

    ``table``: the column whose values have a table each, such as the host.  A
    new flow that finds its table full ends the one not seen for longest.
    events: the table's column, the keys, ``event_id``, ``us``, ``ts``,
    ``direction``, ``tcp_state``, ``bytes``; all but OUTBOUND counts as received.
    """
    text = events.select(events[table], "event_id", "us", "ts", "direction", "tcp_state", "bytes", *(events[k].cast("string").alias(k) for k in keys))
    schema = ", ".join([f"{table} {events.schema[table].dataType.simpleString()}", *(f"{k} string" for k in keys), Flows.entry, "ended_by string"])
    return text.withWatermark("ts", watermark).groupBy(table).transformWithStateInPandas(Flows(table, keys, idle_s, most), schema, "append", "eventTime")
