"""Aggregates over flows, devices, files and processes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.functions.tables import STALE_WRITE, TEMP_IDLE, USB_BYTES, USB_DELETES, USB_EXECUTABLES
from lodewatch.functions.text import extension
from lodewatch.operators.scan import last, running, total
from lodewatch.operators.stateful import first_seen, latest, sessions

ORDER = ("us", "event_id")
FLOW = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def flows(events: DataFrame, keys: Sequence[str] = FLOW) -> DataFrame:
    """First and last time, packets, bytes by direction and the last state of each flow."""
    by = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("bytes"))), F.lit(0))
    return events.groupBy(*keys).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("packets"), by("OUTBOUND").alias("bytes_sent"), by("INBOUND").alias("bytes_recv"), F.max_by("tcp_state", F.struct(*ORDER)).alias("last_state"))


def usb_sessions(events: DataFrame, key: str = "session_key") -> DataFrame:
    """Operations, bytes, extensions and times of each session.

    Rows of operation ``removal`` (and ``arrival``) are the session's ends and
    no activity; ``idle_seconds`` is from the last activity to the end.
    """
    n = lambda op: F.count_if(F.col("operation") == op)
    size = lambda op: F.coalesce(F.sum(F.when(F.col("operation") == op, F.col("size"))), F.lit(0))
    active = ~F.col("operation").isin("arrival", "removal")
    exts = events.where(active).groupBy(key, F.coalesce(F.nullif(extension(F.col("file_path")), F.lit("")), F.lit("(none)")).alias("ext")).agg(F.count("*").cast("int").alias("n"))
    maps = exts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("file_extensions"))
    out = events.groupBy(key).agg(
        n("read").alias("reads"), n("write").alias("writes"), n("delete").alias("deletes"), n("execute").alias("executes"),
        size("read").alias("bytes_read"), size("write").alias("bytes_written"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
        F.max(F.when(active, F.col("us"))).alias("active_us"),
    )
    seconds = lambda a, b: F.round((F.col(b) - F.col(a)) / 1_000_000, 3)
    out = out.withColumns({"duration_seconds": seconds("start_us", "end_us"), "idle_seconds": F.coalesce(seconds("active_us", "end_us"), seconds("start_us", "end_us"))}).drop("active_us")
    return out.join(maps, key, "left").withColumn("file_extensions", F.coalesce("file_extensions", F.create_map().cast("map<string,int>")))


def usb_reports(events: DataFrame, key: str = "session_key") -> DataFrame:
    """A8 with C9: each session with its ``anomalies`` in the order in which they came."""
    found = usb_anomalies(events, key).join(events.select("event_id", "us"), "event_id")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "anomaly"))).alias("a")).select(key, F.col("a.anomaly").alias("anomalies"))
    return usb_sessions(events, key).join(lists, key, "left").withColumn("anomalies", F.coalesce("anomalies", F.array().cast("array<string>")))


def usb_anomalies(events: DataFrame, key: str = "session_key", bytes_: int = USB_BYTES, deletes: int = USB_DELETES) -> DataFrame:
    """Executables written (each path once), and the first event at which bytes or deletions pass their limits."""
    run = Window.partitionBy(key).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda op, v: F.coalesce(F.sum(F.when(F.col("operation") == op, v)).over(run), F.lit(0))
    at = events.withColumns({"r": total("read", F.col("size")), "w": total("write", F.col("size")), "d": total("delete", F.lit(1))})
    mb = lambda c: F.floor(F.col(c) / (1 << 20)).cast("string")
    op = F.col("operation")
    exe = (op == "write") & extension(F.col("file_path")).isin(*USB_EXECUTABLES)
    found = at.select(key, *ORDER, F.explode(F.array_compact(F.array(
        F.when(exe, F.struct(F.concat(F.lit("executable_written: "), "file_path").alias("once"), F.concat(F.lit("executable_written: "), "file_path").alias("anomaly"))),
        F.when((op == "read") & (F.col("r") >= bytes_), F.struct(F.lit("high_read_volume").alias("once"), F.concat(F.lit("high_read_volume: "), mb("r"), F.lit(" MB read")).alias("anomaly"))),
        F.when((op == "write") & (F.col("w") >= bytes_), F.struct(F.lit("high_write_volume").alias("once"), F.concat(F.lit("high_write_volume: "), mb("w"), F.lit(" MB written")).alias("anomaly"))),
        F.when((op == "delete") & (F.col("d") >= deletes), F.struct(F.lit("mass_deletion").alias("once"), F.concat(F.lit("mass_deletion: "), F.col("d").cast("string"), F.lit(" files deleted")).alias("anomaly"))),
    ))).alias("x"))
    return found.groupBy(key, F.col("x.once").alias("once")).agg(F.min_by("x.anomaly", F.struct(*ORDER)).alias("anomaly"), F.min(F.struct(*ORDER)).alias("at")).select(key, "anomaly", F.col("at.event_id").alias("event_id"))


def coalesced_writes(events: DataFrame, key: str = "file_key", stale_s: int = STALE_WRITE) -> DataFrame:
    """A10: one row for the writes of a key up to its next close, delete or idle time; deleted ones are dropped."""
    ended = running(events, [key], {"episode": total(F.col("action").isin("close", "delete"), before=True)})
    closing = ended.where("action in ('close', 'delete')").select(key, "episode", F.col("action").alias("closed_by"))
    parts = sessions(ended.where("action = 'write'"), [key, "episode"], stale_s)
    rows = parts.groupBy(key, "episode", "session").agg(F.count("*").alias("write_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    rows = rows.withColumn("is_last", F.col("session") == F.max("session").over(Window.partitionBy(key, "episode")))
    out = rows.join(closing, [key, "episode"], "left")
    how = F.when(~F.col("is_last"), "stale").otherwise(F.coalesce("closed_by", F.lit("stale")))
    return out.select(key, "write_count", "first_us", "last_us", how.alias("flushed_by")).where("flushed_by <> 'delete'")


def temp_buckets(events: DataFrame, keys: Sequence[str] = ("directory", "pid"), idle_s: int = TEMP_IDLE, path: str | None = None) -> DataFrame:
    """Files created, deleted and elevated in a folder by a process, until it is idle.

    With the column ``path`` files are told apart: a bucket also ends when none
    of its files is alive, and a file that is elevated once is counted as
    elevated, whatever comes after.  A file lives from its first event to its
    deletion; another event of its name is another file.
    """
    n = lambda a: F.count_if(F.col("action") == a)
    parts = sessions(events, keys, idle_s)
    times = F.min("us").alias("first_us"), F.max("us").alias("last_us")
    if path is None:
        return parts.groupBy(*keys, "session").agg(n("create").alias("total_created"), n("delete").alias("total_deleted"), F.count_if("elevated").alias("elevated_count"), *times)
    deleted = F.col("action") == "delete"
    of_file = Window.partitionBy(*keys, "session", path).orderBy(*ORDER)
    of_part = Window.partitionBy(*keys, "session").orderBy(*ORDER)
    born = F.coalesce(F.lag("action").over(of_file) == "delete", F.lit(True))
    at = parts.withColumn("born_", born.cast("int"))
    at = at.withColumn("life_", F.sum("born_").over(of_file)).withColumn("alive_", F.sum(F.col("born_") - deleted.cast("int")).over(of_part))
    ended = F.coalesce(F.sum((F.col("alive_") == 0).cast("int")).over(of_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = at.withColumn("bucket", ended).groupBy(*keys, "session", "bucket", path, "life_").agg(F.max("born_").alias("born"), F.max(deleted.cast("int")).alias("gone"), F.max(F.col("elevated").cast("int")).alias("up"), *times)
    return files.groupBy(*keys, "session", "bucket").agg(F.sum("born").alias("total_created"), F.sum("gone").alias("total_deleted"), F.sum("up").alias("elevated_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def churning(events: DataFrame, key: str, width_s: int, least: int, hold_s: int | None = None) -> DataFrame:
    """Folders with so many events within a tumbling window; with a hold, all windows up to so long after its start."""
    w = width_s * 1_000_000
    found = events.groupBy(key, (F.floor(F.col("us") / w) * w).alias("window_us")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if hold_s is None:
        return found
    later = F.explode(F.sequence(F.col("window_us"), F.col("window_us") + (hold_s * 1_000_000 - 1) // w * w, F.lit(w)))
    return found.select(key, later.alias("window_us")).distinct()


def child_counts(events: DataFrame) -> DataFrame:
    """Running children, distinct child names and threads of each parent, which a stop of the parent clears.

    ``new_child`` is true at the start of a child from an odd place (column
    ``odd``, if there is one); that start uses it up.  events: ``parent_pid``,
    ``kind`` (start, stop, thread or anything else), ``child_name``.
    """
    started = F.col("kind") == "start"
    life = running(events, ["parent_pid"], {"life": total(F.col("kind") == "stop")})
    odd = started & F.coalesce("odd", F.lit(False)) if "odd" in events.columns else F.lit(False)
    out = first_seen(life, ["parent_pid", "life", "kind", "child_name"]).withColumn("fresh", (started & F.col("novel")).cast("int"))
    counts = {"child_count": total(started), "unique_children": total(F.col("fresh")), "thread_count": total(F.col("kind") == "thread")}
    return running(out, ["parent_pid", "life"], counts).select("event_id", "parent_pid", "kind", *counts, odd.alias("new_child"))


def parents(events: DataFrame) -> DataFrame:
    """Starts with ``parent_path`` and ``parent_start_us`` of the last start of their parent's id before them.

    events: ``kind``, ``pid``, ``parent_pid``, ``path``.
    """
    starts = events.where("kind = 'start'")
    known = starts.select(F.col("pid").alias("parent_pid"), "us", F.col("path").alias("parent_path"), F.col("us").alias("parent_start_us"))
    return latest(starts, known, ["parent_pid"], ["parent_path", "parent_start_us"])


def ui_stats(groups: DataFrame) -> DataFrame:
    """Groups, the sum of their unique events, occurrences, and the longest span between starts and ends within a day."""
    total = groups.agg(F.count("*").alias("total_groups"), F.sum("unique_events").alias("unique_events"), F.sum("total_occurrences").alias("total_events"))
    day = 86_400_000_000
    times = groups.select(F.explode(F.array("start_us", "end_us")).alias("us")).where("us is not null")
    span = times.groupBy(F.floor(F.col("us") / day)).agg((F.max("us") - F.min("us")).alias("span")).agg(F.max("span").alias("span_us"))
    return total.join(span)


def matching_groups(groups: DataFrame, corr_type: str = "all", search: str = "") -> DataFrame:
    """groups of a type, in whose id, type, processes, addresses or users the text occurs."""
    out = groups if corr_type == "all" else groups.where(F.col("corr_type") == corr_type)
    said = F.lower(F.concat_ws(" ", "corr_id", "corr_type", "processes", "dest_ips", "users"))
    return out.where(said.contains(search.lower())) if search else out


def shortened(groups: DataFrame, processes: int = 2, addresses: int = 6) -> DataFrame:
    """The first processes and addresses of each group, as a table shows them."""
    return groups.withColumns({"processes": F.slice("processes", 1, processes), "dest_ips": F.slice("dest_ips", 1, addresses)})


def stop_identity(events: DataFrame) -> DataFrame:
    """Each stop with the path and time of the last start of its process id since the stop before."""
    none = F.struct(*(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("path", "us")))
    left = F.when(F.col("kind") == "start", F.struct("path", "us")).when(F.col("kind") == "stop", none)
    return running(events, ["pid"], {"s": last(left, before=True)}).where("kind = 'stop'").select("event_id", "pid", F.col("s.path").alias("path"), F.col("s.us").alias("start_us"), (F.col("us") - F.col("s.us")).alias("lifetime_us"))
