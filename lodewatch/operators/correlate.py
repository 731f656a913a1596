"""Links between events, correlated groups and their assembly.

Every rule gives edges that are linear in the events: cliques become stars to
their first member, and time windows become links to neighbours in order, which
have the same components as all pairs within the window.  First members are
found by aggregation and joined back, so that no key's events are sorted or
held by one task; what needs an order is cut into cells of time, so that a busy
process is many partitions.  Ids may be of any type with an order.  Events with a
column ``host_id`` are linked within one host only, as process ids, names and
addresses of unlike hosts have nothing in common.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.functions.tables import GENERIC_PROCESSES, SCRIPT_WINDOW, TIME_WINDOW
from lodewatch.operators.components import Links, components
from lodewatch.operators.scan import last, running, total
from lodewatch.shared import steps, table_path, written

ORDER = ("us", "event_id")
#: Windows of time in a cell; an event within a window of a cell's border is in two.
CELL = 64
#: Hex digits of an id that make a number of eight bytes.
DIGITS = 15
#: R1 to R6.
RULES = ("pid", "file", "window", "flow", "user", "script")


def host_of(events: DataFrame) -> list[str]:
    """The column that keeps hosts apart, if the events have one."""
    return [c for c in ("host_id",) if c in events.columns]


def specific(process: Column) -> Column:
    return (process != "") & ~F.lower(process).isin(*GENERIC_PROCESSES)


def star(events: DataFrame, keys: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Each event of a key with the key's first; ``a`` is the first.

    having: a condition on the whole key, over ``lo`` and ``hi``, the extremes of the column ``mark``.
    """
    keys = {c: F.col(c) for c in host_of(events)} | keys
    own = events.select("event_id", "us", *([F.col("mark")] if having is not None else []), *(c.alias(f"k_{n}") for n, c in keys.items()))
    names = [f"k_{n}" for n in keys]
    more = [F.min("mark").alias("lo"), F.max("mark").alias("hi")] if having is not None else []
    firsts = own.groupBy(*names).agg(F.min_by("event_id", F.struct(*ORDER)).alias("a"), F.count("*").alias("n"), *more).where("n > 1")
    if having is not None:
        firsts = firsts.where(having)
    firsts = firsts.select("a", *(F.col(n).alias(f"f{n}") for n in names))
    same = functools.reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"f{n}")) for n in names))
    return own.join(firsts, same).select("a", F.col("event_id").alias("b")).where("a <> b")


def same_pid(events: DataFrame, gap: int | None = None) -> DataFrame:
    """Events of one process id; with a gap (seconds), only neighbours no further apart."""
    known = events.where("pid > 0")
    if gap is None:
        return star(known, {"pid": F.col("pid")})
    own, keys = F.struct("us", "event_id"), [*host_of(events), "pid"]
    near = running(known.select(*keys, *ORDER), keys, {"x": last(own, before=True)})
    return near.where(F.col("us") - F.col("x.us") <= gap * 1_000_000).select(F.col("x.event_id").alias("a"), F.col("event_id").alias("b"))


def cross_file(events: DataFrame) -> DataFrame:
    """R2: events of one specific process that several files have."""
    named = events.where(specific(F.col("process_name"))).withColumn("mark", F.col("source_file"))
    return star(named, {"name": F.lower("process_name")}, F.col("lo") != F.col("hi"))


def _cell(us: Column, span: int) -> Column:
    return F.call_function("div", us - F.pmod(us, F.lit(span)), F.lit(span))


def _in_cells(timed: DataFrame, w: int) -> DataFrame:
    """Adds ``cell``, and ``own``, false for copies: every event meets in its own cell all events within ``w`` of it."""
    us, span = F.col("us"), CELL * w
    cells = F.array_distinct(F.array(_cell(us - w, span), _cell(us, span), _cell(us + w, span)))
    return timed.withColumn("cell", F.explode(cells)).withColumn("own", F.col("cell") == _cell(us, span))


def same_window(events: DataFrame, window: int = TIME_WINDOW) -> DataFrame:
    """Events of one specific process within the window, and of one source address where both have one.

    Linked are neighbours with the same address (none is one too), and each
    event with an address to the nearest without one, before and after.  The
    nearest after is the last before in the reverse order, so that all frames
    grow by a row at a time.
    """
    name, w = F.lower("process_name").alias("name"), window * 1_000_000
    host = host_of(events)
    timed = events.where(specific(F.col("process_name")) & F.col("us").isNotNull()).select("event_id", "us", *host, name, F.nullif("src_ip", F.lit("")).alias("ip"))
    own = Window.partitionBy(*host, "name", "cell", "ip").orderBy(*ORDER)
    ahead = Window.partitionBy(*host, "name", "cell").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*host, "name", "cell").orderBy(*map(F.desc, ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    bare = F.when(F.col("ip").isNull(), F.struct("us", "event_id"))
    near = _in_cells(timed, w).repartition(*host, "name", "cell").select(
        "event_id", "us", "ip", "own",
        F.struct(F.lag("us").over(own).alias("us"), F.lag("event_id").over(own).alias("event_id")).alias("same"),
        F.last(bare, True).over(ahead).alias("before"),
        F.last(bare, True).over(back).alias("after"),
    ).where("own")
    edge = lambda other, when: F.when(when & (F.abs(F.col("us") - F.col(f"{other}.us")) <= w), F.col(f"{other}.event_id"))
    with_ip = F.col("ip").isNotNull()
    each = near.select(F.explode(F.array(edge("same", F.lit(True)), edge("before", with_ip), edge("after", with_ip))).alias("x"), "event_id").where("x is not null")
    return each.select(F.least("x", "event_id").alias("a"), F.greatest("x", "event_id").alias("b"))


def paired_flow(events: DataFrame) -> DataFrame:
    """Inbound and outbound events of one flow that has both; process id 0 counts."""
    flows = events.where("src_ip <> '' and dst_ip <> '' and direction in ('INBOUND', 'OUTBOUND')").withColumn("mark", F.col("direction"))
    return star(flows, {k: F.col(k) for k in ("src_ip", "dst_ip", "src_port", "dst_port")}, F.col("lo") != F.col("hi"))


def same_user_process(events: DataFrame) -> DataFrame:
    """Events of one user and specific process."""
    return star(events.where((F.col("user_name") != "") & specific(F.col("process_name"))), {"user": F.col("user_name"), "name": F.lower("process_name")})


def nearest_process(events: DataFrame, window: int = SCRIPT_WINDOW, name: str = "powershell") -> DataFrame:
    """Each script event with the nearest start of a process of that name, the earlier one of two as near.

    Both kinds are put in one order, so that the nearest are the last start
    before and the last after in the reverse order; of starts at one time the
    first counts.
    """
    w, host = window * 1_000_000, host_of(events)
    is_start = (F.col("record_type") == "process_start") & F.lower("process_name").contains(name)
    timed = events.where("us is not null")
    starts = timed.where(is_start).groupBy(*host, "us").agg(F.min("event_id").alias("event_id")).withColumn("script", F.lit(0))
    scripts = timed.where(F.col("record_type") == "script_execution").select(*host, "us", "event_id", F.lit(1).alias("script"))
    start = F.when(F.col("script") == 0, F.struct("us", "event_id"))
    order = ("us", "script", "event_id")
    near = running(starts.unionByName(scripts), host, {"before": last(start)}, order)
    near = running(near, host, {"after": last(start, before=True)}, order, reverse=True).where("script = 1")
    option = lambda c: F.when(F.abs(F.col("us") - F.col(f"{c}.us")) <= w, F.struct(F.abs(F.col("us") - F.col(f"{c}.us")).alias("d"), F.col(f"{c}.us").alias("us"), F.col(f"{c}.event_id").alias("event_id")))
    return near.select(F.array_min(F.array_compact(F.array(option("before"), option("after")))).alias("x"), "event_id").where("x is not null").select(F.col("x.event_id").alias("a"), F.col("event_id").alias("b"), F.col("x.d").alias("distance_us"))


def links(events: DataFrame, window: int = TIME_WINDOW, script_window: int = SCRIPT_WINDOW, pid_gap: int | None = None, rules: Sequence[str] = RULES) -> list[DataFrame]:
    """The links of the rules by name; all six unless told otherwise."""
    made = {
        "pid": lambda: same_pid(events, pid_gap), "file": lambda: cross_file(events), "window": lambda: same_window(events, window),
        "flow": lambda: paired_flow(events), "user": lambda: same_user_process(events), "script": lambda: nearest_process(events, script_window),
    }
    return [made[r]() for r in rules]


def assign(events: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """Adds ``component``: the smallest event id that links lead to."""
    found = components(functools.reduce(DataFrame.unionByName, [e.select("a", "b") for e in edges]))
    return events.join(found.withColumnRenamed("node", "event_id"), "event_id", "left").withColumn("component", F.coalesce("component", "event_id"))


def ranked(events: DataFrame) -> DataFrame:
    """Adds ``rank_``, a number that has the order of the event ids, equal ones having one.

    For ids in hex digits that is the number of their first digits, if no two events have the same, so that no row is moved.
    All others are dealt by ranges of their ids and written; they lose the column ``slice_``.
    """
    number = first_digits(events)
    if events.groupBy(number.alias("number_")).agg(F.count("*").alias("n")).where("number_ is null or n > 1").isEmpty():
        return events.withColumn("rank_", number)
    dealt = events.drop("slice_").repartitionByRange("event_id").sortWithinPartitions("event_id").withColumn("rank_", F.monotonically_increasing_id())
    return written(dealt.withColumn("rank_", F.min("rank_").over(Window.partitionBy("event_id"))), "ranked")


def first_digits(events: DataFrame) -> Column:
    """The number of the first digits of an id that has so many hex digits; null for other ids."""
    event_id = F.col("event_id").cast("string")
    return F.when(event_id.rlike(f"^[0-9a-f]{{{DIGITS}}}"), F.conv(F.substring(event_id, 1, DIGITS), 16, 10).cast("long"))


def in_slice(number: Column | str, slices: int) -> Column:
    """Which of the slices a number is of; none is of the first."""
    return F.pmod(F.coalesce(number, F.lit(0)), F.lit(slices)).cast("int")


def assign_ranked(events: DataFrame, edges: list[DataFrame], path: str, slices: int = 1, done: Callable[[int], None] = lambda _: None, ids: bool = True) -> DataFrame:
    """``assign`` for links between the ``rank_`` of events, written to ``path``: with ``group_``, the smallest number that links lead to, and ``first_``, whether it is the event's own.

    One slice of the events is joined after the other, so that no more of them lies in shuffle files; ``done`` is told each.
    Without ``ids``, only events that name a group keep theirs.
    """
    spark = events.sparkSession
    aside = table_path(spark, "found")
    with steps(spark):
        found = written(components(Links(edges)).select(F.col("node").alias("rank_"), F.col("component").alias("group_")), "found", aside)
    own = F.col("slice_") if "slice_" in events.columns else in_slice("rank_", slices)
    group = F.coalesce("group_", "rank_")
    for s in range(slices):
        joined = events.where(own == s).join(found.where(in_slice("rank_", slices) == s), "rank_", "left")
        joined = joined.withColumns({"group_": group, "first_": group == F.col("rank_")}).drop("rank_", "slice_")
        if not ids:
            joined = joined.withColumn("event_id", F.when(F.col("first_"), F.col("event_id")))
        joined.write.mode("append").parquet(path)
        done(s)
    return spark.read.schema(joined.schema).parquet(path)


def named(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows with ``component``, the event id of their ``group_``, in its place; ``grouped``: the events as ``assign_ranked`` leaves them."""
    names = grouped.where("first_").groupBy("group_").agg(F.min("event_id").alias("component"))
    return rows.join(names, "group_").drop("group_", "first_")


def group_type(types: Column) -> Column:
    """From the array of record types."""
    p, n, s = (F.array_contains(types, t) for t in ("process_start", "network_connect", "script_execution"))
    return (
        F.when(p & n & s, "full_activity_session").when(p & n, "process_with_network").when(p & s, "process_with_script").when(n & s, "network_with_script")
        .when(p, "process_session").when(n, "network_flow").when(s, "script_session").otherwise("mixed")
    )


def corr_id(grouped: DataFrame, group: str) -> Column:
    """``CG-`` and the group's id: all 16 hex digits of a number, 32 digits (128 bits) of a longer one that is text already."""
    text = grouped.schema[group].dataType.simpleString() == "string"
    return F.concat(F.lit("CG-"), F.upper(F.substring(group, 1, 32) if text else F.lpad(F.hex(group), 16, "0")))


SIGNATURE = ("record_type", "source", "process_name", "user_name", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "script_content")


def collapse(grouped: DataFrame, group: str = "component") -> DataFrame:
    """One row for each action of a group: count, first and last time, and the first event."""
    return grouped.groupBy(group, *SIGNATURE).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min(F.struct(*ORDER))["event_id"].alias("first_event"))


def assemble(grouped: DataFrame, group: str = "component") -> DataFrame:
    """A row for each group; sets are sorted arrays without empty values.

    Its events stay rows, as ``collapse`` gives them under the group's id, so
    that no group's events are held at once; ``nested`` puts them together in
    bounded parts.
    """
    actions = actions_of(grouped, group)
    return of_actions(actions, unique_of(actions, group), group)


def actions_of(grouped: DataFrame, group: str) -> DataFrame:
    """Partial aggregation by action: counts and extremes of a group follow from its actions'."""
    return grouped.groupBy(group, *SIGNATURE, "source_file", "pid").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))


def unique_of(actions: DataFrame, group: str) -> DataFrame:
    return actions.select(group, *SIGNATURE).distinct().groupBy(group).agg(F.count("*").alias("unique_events"))


def of_actions(actions: DataFrame, unique: DataFrame, group: str) -> DataFrame:
    """``assemble`` for ``actions_of`` events and ``unique_of`` these."""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    out = actions.groupBy(group).agg(
        F.sum("n").alias("total_occurrences"), F.min("lo").alias("start_us"), F.max("hi").alias("end_us"),
        some("source_file").alias("source_files"), some("record_type").alias("record_types"), some("process_name").alias("processes"), some("user_name").alias("users"),
        F.array_sort(F.collect_set(F.when(F.col("pid") > 0, F.col("pid")))).alias("pids"), some("dst_ip").alias("dest_ips"), some("protocol").alias("protocols"),
    )
    seconds = F.coalesce(F.round((F.col("end_us") - F.col("start_us")) / 1_000_000, 2), F.lit(0.0))
    out = out.join(unique, group).withColumns({"corr_type": group_type(F.col("record_types")), "duration_seconds": seconds})
    return out.withColumn("corr_id", corr_id(out, group))


def nested(grouped: DataFrame, group: str = "component", per_part: int = 1000) -> DataFrame:
    """The actions of each group as arrays ``events``, in time order, in parts of at most so many: ``part`` from 0."""
    return in_parts(collapse(grouped, group), group, per_part)


def in_parts(actions: DataFrame, group: str = "component", per_part: int = 1000) -> DataFrame:
    """``nested`` for actions as ``collapse`` leaves them."""
    placed = running(actions, [group], {"place": total(F.lit(1), before=True)}, ("first_us", "first_event"))
    placed = placed.withColumn("part", F.floor(F.col("place") / per_part).cast("int"))
    event = F.struct(F.col("first_us"), F.col("first_event"), F.col("last_us"), F.when(F.col("n") > 1, F.col("n")).alias("count"), *SIGNATURE)
    return placed.groupBy(group, "part").agg(F.array_sort(F.collect_list(event)).alias("events"))


def dedup_groups(groups: DataFrame) -> DataFrame:
    """Groups of one signature become the one with most events (of equals, the smallest id); events are summed, ``repeat_count`` is null if it was alone."""
    keys = ["corr_type", "processes", "dest_ips", "protocols", "source_files"]
    others = [c for c in groups.columns if c not in (*keys, "total_occurrences")]
    best = groups.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(-F.col("total_occurrences"), F.col("component"))).alias("g"), F.sum("total_occurrences").alias("total_occurrences"), F.count("*").alias("groups"))
    return best.select(*keys, "g.*", "total_occurrences", F.when(F.col("groups") > 1, F.col("groups")).alias("repeat_count"))


def in_order(events: DataFrame) -> DataFrame:
    """L1: by time, events without one first; equal times by id."""
    return events.orderBy(F.asc_nulls_first("us"), "event_id")


def largest_first(groups: DataFrame) -> DataFrame:
    """L2: by occurrences, most first; equal ones by id."""
    return groups.orderBy(F.desc("total_occurrences"), "corr_id")


def largest(groups: DataFrame, n: int) -> DataFrame:
    """L2: the first ``n`` groups by occurrences, and all that are as large as the last of them, with their ``place``; few rows leave each task."""
    return groups.withColumn("place", F.rank().over(Window.orderBy(F.desc("total_occurrences"))).cast("long")).where(F.col("place") <= n)
