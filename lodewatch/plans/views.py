"""The standard tables as telemetry: plain derivations, in Spark and in the same words of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIFIED = """
SELECT event_id, us, k, v, event_type, user_id AS pid,
  CASE event_type WHEN 'signup' THEN 'process_start' WHEN 'purchase' THEN 'process_stop' WHEN 'error' THEN 'script_execution' ELSE 'network_connect' END AS record_type,
  'sensor' AS source, concat('src', event_id % 3) AS source_file,
  CASE k % 12 WHEN 0 THEN 'svchost.exe' WHEN 1 THEN 'PowerShell.exe' ELSE concat('proc', k % 12, '.exe') END AS process_name,
  concat('user', user_id % 20) AS user_name,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('10.0.', k % 4, '.', user_id % 250) END AS src_ip,
  CASE WHEN k % 5 = 0 THEN concat('192.168.1.', user_id % 250) WHEN k % 7 = 0 THEN '100.64.0.1' ELSE concat('8.8.', k % 7, '.', user_id % 200 + 1) END AS dst_ip,
  50000 + user_id % 10 AS src_port,
  CASE k % 6 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 3389 WHEN 4 THEN 445 ELSE 9999 END AS dst_port,
  CASE k % 6 WHEN 0 THEN 'HTTPS_TLS' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'DNS' WHEN 3 THEN 'RDP' WHEN 4 THEN 'SMB' ELSE 'UNKNOWN' END AS protocol,
  CASE WHEN event_id % 2 = 0 THEN 'OUTBOUND' ELSE 'INBOUND' END AS direction,
  CASE k % 4 WHEN 0 THEN 'SYN_SENT' WHEN 1 THEN 'SYN_RECEIVED' WHEN 2 THEN 'CLOSED' ELSE 'ESTABLISHED' END AS tcp_state,
  CAST('' AS {string}) AS script_content, v AS bytes,
  CASE WHEN k % 11 = 0 THEN concat('host', k, '.example.com') ELSE '' END AS domain
FROM raw_events
"""

RAW = "SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"

#: The view as common table expressions for DuckDB.
SQL = f"raw_events AS ({RAW}), u AS ({UNIFIED.format(string='VARCHAR')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unified_of(events: DataFrame) -> DataFrame:
    """Rows of ``events``, a table or a stream, as unified telemetry events."""
    raw = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return events.sparkSession.sql(UNIFIED.replace("raw_events", "{raw_events}").replace("{string}", "STRING"), raw_events=raw)


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as unified telemetry events."""
    return unified_of(table(spark, sf_dir, "events"))
