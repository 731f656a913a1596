"""Streaming forms over the standard tables: each reads the events as a stream to its end.

What a timer ends is there if the watermark, a delay behind the last event, has
passed the timer; SQL says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.plans import queries as Q
from lodewatch.plans.endpoint import _TEMP
from lodewatch.plans.registry import query, with_view
from lodewatch.plans.views import unified_of
from lodewatch.streaming import keyed, run, stateful

#: Delay of the watermark; the tables' events are hours apart.
DELAY = 3600
DAY = 86400


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a stream, with ``ts``."""
    # As a pattern, since a stream reads folders or patterns and not one file.
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return unified_of(run.source(spark, f"{sf_dir}/[e]vents.parquet", schema)).withColumn("ts", F.timestamp_micros("us"))


_MARK = f"(SELECT max(us) // 1000 * 1000 - {DELAY}000000 FROM u)"


@query(Q._recursive((DAY + 1) * 1_000_000) + "SELECT pid, event_id, nth = 1 AS forwarded, anchor_us, nth FROM a")
def stream_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T13"""
    out = run.whole(stateful.anchored_stream(_events(spark, sf_dir), "pid", (DAY + 1) * 1_000_000, f"{DELAY} seconds"), "anchored")
    return out.select(F.col("pid").cast("long").alias("pid"), "event_id", "forwarded", "anchor_us", "nth")


@query(Q._recursive((DAY + 1) * 1_000_000) + f"SELECT * FROM (SELECT pid, anchor_us, max(nth) AS repeat_count, max(us) AS last_us FROM a GROUP BY pid, anchor_us HAVING max(nth) >= 2) w WHERE anchor_us < (SELECT max(anchor_us) FROM a WHERE a.pid = w.pid) OR (anchor_us + {DAY + 1}000000) // 1000 * 1000 < {_MARK}")
def stream_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2"""
    out = run.whole(stateful.summary_stream(_events(spark, sf_dir), "pid", (DAY + 1) * 1_000_000, f"{DELAY} seconds"), "summaries")
    return out.withColumn("pid", F.col("pid").cast("long"))


_SPLIT = """ep AS (SELECT *, coalesce(sum(CASE WHEN action <> 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode
  FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'close' WHEN 'signup' THEN 'delete' ELSE 'write' END AS action FROM u)),
w AS (SELECT *, max(session) OVER (PARTITION BY pid, episode) AS last_session FROM (SELECT *, sum(far) OVER (PARTITION BY pid, episode ORDER BY us, event_id) AS session FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY pid, episode ORDER BY us, event_id) > 36000000000 THEN 1 ELSE 0 END AS far FROM ep WHERE action = 'write'))),
g AS (SELECT pid, episode, session, count(*) AS write_count, min(us) AS first_us, max(us) AS last_us, any_value(session = last_session) AS is_last FROM w GROUP BY pid, episode, session),
c AS (SELECT pid, episode, action FROM ep WHERE action <> 'write')"""


@query(with_view(f"SELECT g.pid, write_count, first_us, last_us, CASE WHEN is_last AND action IS NOT NULL THEN action ELSE 'stale' END AS flushed_by FROM g LEFT JOIN c USING (pid, episode) WHERE CASE WHEN NOT is_last THEN true WHEN action IS NULL THEN (last_us + 36000000000) // 1000 * 1000 < {_MARK} ELSE action = 'close' END", _SPLIT))
def stream_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, T6"""
    action = F.when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "signup", "delete").otherwise("write")
    out = run.whole(stateful.coalesced_stream(_events(spark, sf_dir).withColumn("action", action), "pid", 36000, f"{DELAY} seconds"), "writes")
    return out.withColumn("pid", F.col("pid").cast("long"))


@query(with_view("""SELECT pid, min(us) AS start_us, max(us) AS end_us, count(*) FILTER (WHERE kind = 'read') AS reads, count(*) FILTER (WHERE kind = 'write') AS writes, coalesce(sum(bytes) FILTER (WHERE kind = 'read'), 0)::BIGINT AS bytes_read, true AS removed FROM (
  SELECT *, CAST(sum(CASE WHEN kind = 'arrival' AND coalesce(before_kind, 'removal') = 'removal' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
    SELECT *, last_value(CASE WHEN kind IN ('arrival', 'removal') THEN kind END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS last_kind, last_value(CASE WHEN kind IN ('arrival', 'removal') THEN kind END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_kind
    FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'arrival' WHEN 'purchase' THEN 'removal' WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' ELSE 'rename' END AS kind FROM u))
  WHERE last_kind = 'arrival' OR (kind = 'removal' AND before_kind = 'arrival')) GROUP BY pid, session HAVING bool_or(kind = 'removal')"""))
def stream_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, T8"""
    kind = F.when(F.col("event_type") == "signup", "arrival").when(F.col("event_type") == "purchase", "removal").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "write").otherwise("rename")
    events = _events(spark, sf_dir).withColumns({"kind": kind, "size": F.col("bytes")})
    out = run.whole(stateful.device_stream(events, "pid", 100 * DAY, f"{DELAY} seconds"), "devices")
    return out.select(F.col("pid").cast("long").alias("pid"), "start_us", "end_us", "reads", "writes", "bytes_read", "removed")


@query(with_view(f"""SELECT src_ip, dst_ip, min(us) AS first_us, count(*) AS packets, coalesce(sum(bytes) FILTER (WHERE direction = 'OUTBOUND'), 0)::BIGINT AS bytes_sent, coalesce(sum(bytes) FILTER (WHERE direction = 'INBOUND'), 0)::BIGINT AS bytes_recv FROM (
  SELECT *, sum(far) OVER (PARTITION BY src_ip, dst_ip ORDER BY us, event_id) AS session FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip, dst_ip ORDER BY us, event_id) >= {DAY}000000 THEN 1 ELSE 0 END AS far FROM u)) GROUP BY src_ip, dst_ip, session HAVING max(us) + {DAY}000000 <= {_MARK}"""))
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, T9"""
    out = run.whole(stateful.flow_stream(_events(spark, sf_dir), ["src_ip", "dst_ip"], f"{DAY} seconds", f"{DELAY} seconds"), "flows")
    return out.select("src_ip", "dst_ip", F.unix_micros("first_seen").alias("first_us"), "packets", "bytes_sent", "bytes_recv")


@query(with_view(f"SELECT directory, start_us, count(*) AS n FROM (SELECT concat('dir', k % 12) AS directory, us // {Q.HOUR}000000 * {Q.HOUR}000000 AS start_us FROM u) GROUP BY ALL HAVING start_us + {Q.HOUR}000000 <= {_MARK}"))
def stream_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of closed windows."""
    events = _events(spark, sf_dir).withColumn("directory", F.concat(F.lit("dir"), F.col("k") % 12))
    out = run.whole(stateful.churn_stream(events, "directory", f"{Q.HOUR} seconds", f"{DELAY} seconds"), "churn")
    return out.select("directory", F.unix_micros("start").alias("start_us"), "n")


@query(with_view("SELECT process_name, dst_ip, count(*) AS n FROM (SELECT DISTINCT process_name, dst_ip FROM u) GROUP BY ALL"))
def stream_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T5"""
    out = run.whole(stateful.novel_stream(_events(spark, sf_dir).select("process_name", "dst_ip", "ts"), ["process_name", "dst_ip"], "400 days"), "novel")
    return out.groupBy("process_name", "dst_ip").agg(F.count("*").alias("n"))


def _reason(now: tuple, row: object) -> str | None:
    if int(row.pid) != now[1] and "powershell" in row.process_name.lower():
        return "suspicious_process_cross_access"
    return "long_lived_temp_file" if (int(row.us) - now[0]) // 1_000_000 > 10 * DAY else None


@query(with_view(f"""SELECT path, n_elevated, CASE WHEN n_elevated = 1 THEN up_us END AS up_us FROM (SELECT path, max(CASE WHEN bad OR timer THEN 1 ELSE 0 END) AS n_elevated, min(CASE WHEN bad THEN us WHEN timer THEN born + {10 * DAY}000000 END) AS up_us FROM (
  SELECT *, last_action = 'write' AND NOT any_bad AND (born + {10 * DAY}000000) // 1000 * 1000 < {_MARK} AS timer FROM (SELECT *, bool_or(bad) OVER (PARTITION BY path) AS any_bad FROM (
    SELECT *, first_value(us) OVER o AS born, (pid <> first_value(pid) OVER o AND contains(lower(process_name), 'powershell')) OR (us - first_value(us) OVER o) // 1000000 > {10 * DAY} AS bad,
      last_value(action) OVER (PARTITION BY path ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_action
    FROM t WINDOW o AS (PARTITION BY path ORDER BY us, event_id)))) GROUP BY path)""",
  "t AS (SELECT event_id, us, pid, process_name, concat('f', pid % 3, '-', k, '.tmp') AS path, CASE WHEN event_type IN ('purchase', 'click') THEN 'delete' ELSE 'write' END AS action FROM u)"))
def stream_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are elevated, and when."""
    action = F.when(F.col("event_type").isin("purchase", "click"), "delete").otherwise("write")
    events = _events(spark, sf_dir).withColumns({"path": F.concat(F.lit("f"), F.col("pid") % 3, F.lit("-"), "k", F.lit(".tmp")), "action": action})
    out = run.whole(stateful.temp_stream(events, "path", _reason, 10 * DAY, f"{DELAY} seconds"), "temp")
    up = F.col("state") == "ELEVATED"
    return out.groupBy("path").agg(F.sum(up.cast("int")).cast("int").alias("n_elevated"), F.min(F.when(up, F.col("us"))).alias("up_us"))


@query(with_view(f"""SELECT directory, pid, created, deleted, elevated, first_us, last_us, CASE WHEN alive = 0 THEN 'empty' ELSE 'idle' END AS ended_by FROM (
  SELECT directory, pid, session, bucket, sum(born)::BIGINT AS created, sum(gone)::BIGINT AS deleted, sum(up)::BIGINT AS elevated, min(lo) AS first_us, max(hi) AS last_us, sum(born)::BIGINT - sum(gone)::BIGINT AS alive, session < max(session) OVER (PARTITION BY directory, pid) AS over
  FROM s5 GROUP BY directory, pid, session, bucket) WHERE alive = 0 OR over OR (last_us + 360000000000) // 1000 * 1000 < {_MARK}""", _TEMP))
def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of temporary files, ended by their last deletion or by a timer."""
    action = F.when(F.col("event_type").isin("purchase", "click"), "delete").otherwise("write")
    events = _events(spark, sf_dir).withColumns({"directory": F.concat(F.lit("dir"), F.col("k") % 6), "pid": F.col("pid") % 10, "path": F.concat(F.lit("f"), F.col("k") % 3), "action": action, "elevated": F.col("event_type") == "error"})
    keyed.store(spark)
    return run.whole(keyed.bucket_stream(events, idle_s=360_000, watermark=f"{DELAY} seconds"), "buckets")


@query(with_view(f"""SELECT source_file, src_ip, dst_ip, first_us, last_us, packets, bytes_sent, bytes_recv, last_state, 'idle' AS ended_by FROM (
  SELECT source_file, src_ip, dst_ip, session, min(us) AS first_us, max(us) AS last_us, count(*) AS packets, coalesce(sum(bytes) FILTER (WHERE direction = 'OUTBOUND'), 0)::BIGINT AS bytes_sent, coalesce(sum(bytes) FILTER (WHERE direction <> 'OUTBOUND'), 0)::BIGINT AS bytes_recv, arg_max(tcp_state, (us, event_id)) AS last_state,
    session < max(session) OVER (PARTITION BY source_file, src_ip, dst_ip) AS over
  FROM (SELECT *, sum(far) OVER (PARTITION BY source_file, src_ip, dst_ip ORDER BY us, event_id) AS session FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY source_file, src_ip, dst_ip ORDER BY us, event_id) > {DAY}000000 THEN 1 ELSE 0 END AS far FROM u))
  GROUP BY source_file, src_ip, dst_ip, session) WHERE over OR (last_us + {DAY}000000) // 1000 * 1000 <= {_MARK}"""))
def stream_flow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow table for each source, with last states."""
    keyed.store(spark)
    return run.whole(keyed.flow_table_stream(_events(spark, sf_dir), "source_file", ("src_ip", "dst_ip"), DAY, watermark=f"{DELAY} seconds"), "flow-table")
