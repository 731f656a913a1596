"""From written files to groups: the view is written in each format, read back, linked, assembled, and written as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodewatch import api, schemas
from lodewatch.operators import aggregates, correlate, enrich, threat
from lodewatch.plans import queries as Q
from lodewatch.plans.registry import query, with_view
from lodewatch.plans.views import RAW, UNIFIED, unified
from lodewatch.shared import released, table_path
from lodewatch.sources import readers, writers

#: Rows of each file as the readers are to give them; every tenth line of the network file is there twice.
_FILES = """
b AS ({view}),
rows AS (
  SELECT event_id * 2 AS event_id, 'network' AS source_file, 'npcap_live' AS source, record_type, us, nullif(pid, 0) AS pid, process_name, '' AS user_name, src_ip, dst_ip, src_port, dst_port, protocol, direction, tcp_state, '' AS script_content, NULL AS pattern_hits
    FROM b WHERE record_type = 'network_connect' AND event_id % 7 <> 0
  UNION ALL SELECT event_id * 2 + 1, 'network', 'npcap_live', record_type, us, nullif(pid, 0), process_name, '', src_ip, dst_ip, src_port, dst_port, protocol, direction, tcp_state, '', NULL
    FROM b WHERE record_type = 'network_connect' AND event_id % 7 <> 0 AND event_id % 10 = 1
  UNION ALL SELECT event_id * 2, 'legacy', 'etw_kernel_process', record_type, us, nullif(pid, 0), process_name, user_name, src_ip, dst_ip, src_port, dst_port, protocol, direction, tcp_state, '', NULL
    FROM b WHERE record_type = 'network_connect' AND event_id % 7 = 0
  UNION ALL SELECT event_id * 2, 'process', 'process', record_type, us, nullif(pid, 0), process_name, user_name, '', '', NULL, NULL, '', '', '', '', NULL FROM b WHERE record_type IN ('process_start', 'process_stop')
  UNION ALL SELECT event_id * 2, 'applog', 'PowerShell', 'script_execution', us - us % 1000000, NULL, 'powershell.exe', '', '', '', NULL, NULL, '', '', '', concat('{{ "x": ', k, ' }}'), CAST(k % 5 AS INT) FROM b WHERE record_type = 'script_execution'
)
"""
_SQL = "raw_events AS (" + RAW + ")," + _FILES.format(view=UNIFIED.format(string="VARCHAR")) + ", u AS (SELECT * FROM rows)"


#: Files are compressed, and so many records of them are read by one task.
_PACKED, _PER_FILE = "gzip", 250_000


def _written(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Paths by name, of files that are written anew for each query."""
    b = unified(spark, sf_dir)
    paths = {n: table_path(spark, n) for n in ("network", "legacy", "process", "applog")}
    iso = lambda pattern: F.date_format(F.to_utc_timestamp(F.timestamp_micros("us"), F.current_timezone()), pattern)
    exact = iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")
    flow = ["src_port", "dst_port", "protocol", "direction"]
    net = b.where("record_type = 'network_connect'")
    new = net.where("event_id % 7 <> 0").withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = new.select(exact, F.lit("npcap_live").alias("source"), "record_type", "pid", "process_name", "src_ip", "dst_ip", *flow, F.col("tcp_state").alias("state"))
    broken = spark.createDataFrame([('"ts":"2026-01-05T10:00:01Z","pid":5}',), ("",), ("{",), ('["a"]',)], "value string")
    new.select(writers.sparse(new).alias("value")).unionByName(broken).write.option("maxRecordsPerFile", _PER_FILE).text(paths["network"], _PACKED)
    old = net.where("event_id % 7 = 0").select(exact, F.lit("etw_kernel_process").alias("source"), "record_type", "pid", "process_name", "user_name", F.col("src_ip").alias("local_addr"), F.col("dst_ip").alias("remote_addr"), F.col("src_port").alias("local_port"), F.col("dst_port").alias("remote_port"), "protocol", "direction", "tcp_state")
    writers.write_lines(old, paths["legacy"], _PER_FILE, compression=_PACKED)
    writers.write_lines(b.where("record_type in ('process_start', 'process_stop')").select(exact, F.lit("FORWARD").alias("event_type"), F.col("record_type").alias("event_subtype"), "pid", "process_name", "user_name"), paths["process"], _PER_FILE, compression=_PACKED)
    script = b.where("record_type = 'script_execution'").select(F.lit("PowerShell").alias("source"), F.lit("4104").alias("event_id"), iso("yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit('{ "x": '), "k", F.lit(" }")).alias("script_content"), (F.col("k") % 5).alias("pattern_hits"))
    script.select(F.to_json(F.struct(*script.columns), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", _PER_FILE).text(paths["applog"], _PACKED)
    return paths


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _written(spark, sf_dir)
    return readers.Normalizers().ingest(spark, list(paths.values()), {p: n for n, p in paths.items()})


@query(f"WITH {_SQL} SELECT source_file, source, record_type, us, pid, process_name, user_name, src_ip, dst_ip, src_port, dst_port, protocol, direction, tcp_state, script_content, pattern_hits, count(*) AS n, count(*) AS ids FROM u GROUP BY ALL")
def ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sniffed, read and normalized; equal lines have ids of their own."""
    keys = ["source_file", "source", "record_type", "us", "pid", "process_name", "user_name", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "tcp_state", "script_content", "pattern_hits"]
    out = _ingested(spark, sf_dir).withColumns({"src_port": F.col("src_port").cast("long"), "dst_port": F.col("dst_port").cast("int")})
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


_MIXED = with_view("SELECT record_type, source, pid, us, process_name, count(*) AS n, count(*) AS ids FROM (SELECT CASE WHEN event_id % 4 = 2 THEN 'process_start' ELSE 'network_connect' END AS record_type, CASE WHEN event_id % 4 = 2 THEN 'process' ELSE 'npcap_live' END AS source, pid, us, CASE WHEN event_id % 4 = 3 THEN concat('}{\"', process_name) ELSE process_name END AS process_name FROM u) GROUP BY ALL")


@query(_MIXED)
def mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of lines, pretty-printed objects, lines of another format, and objects one after the other on long lines."""
    b = unified(spark, sf_dir).withColumn("ts", F.date_format(F.to_utc_timestamp(F.timestamp_micros("us"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    path = table_path(spark, "mixed")
    network = ["ts", F.lit("npcap_live").alias("source"), F.lit("network_connect").alias("record_type"), "pid", "process_name"]
    part = lambda i: b.where(F.col("event_id") % 4 == i)
    whole = lambda df, **o: F.to_json(F.struct(*df.columns), o)
    rows = part(0).select(*network)
    rows.select(whole(rows).alias("value")).write.mode("append").text(path)
    rows = part(1).select(*network)
    rows.select(whole(rows, pretty="true").alias("value")).write.mode("append").text(path)
    rows = part(2).select("ts", F.lit("process_start").alias("event_subtype"), "pid", "process_name")
    rows.select(whole(rows).alias("value")).write.mode("append").text(path)
    rows = part(3).withColumn("process_name", F.concat(F.lit('}{"'), "process_name")).select("event_id", *network)
    fifty = rows.select(F.floor(F.col("event_id") / 200).alias("line"), whole(rows.drop("event_id")).alias("value")).groupBy("line").agg(F.array_join(F.collect_list("value"), "").alias("value"))
    fifty.select("value").write.mode("append").text(path)
    keys = ["record_type", "source", "pid", "us", "process_name"]
    return readers.Normalizers().read(spark, path).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT bucket, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY bucket ORDER BY event_id) AS BIGINT) AS number, event_id FROM (SELECT event_id, CAST(event_id % 8 AS INT) AS bucket FROM events)")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: numbers of lines in their files, of which some are blank; ids are of these and the path."""
    b = Q.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8).cast("int").alias("bucket"))
    path = table_path(spark, "numbered")
    line = F.concat(F.when(F.col("event_id") % 5 == 0, "\n").otherwise(""), F.to_json(F.struct("event_id")))
    b.repartition("bucket").sortWithinPartitions("bucket", "event_id").select("bucket", line.alias("value")).write.partitionBy("bucket").text(path)
    found = readers.lines(spark, path, StructType([StructField("event_id", LongType())]), "log")
    place = lambda pattern: F.regexp_extract("line", pattern, 1)
    return found.select(place(r"^log/bucket=(\d+)/").cast("int").alias("bucket"), place(r":(\d+)$").cast("long").alias("number"), "event_id")


@query("SELECT event_type AS name, CASE event_type WHEN 'signup' THEN 'process' WHEN 'purchase' THEN 'legacy' WHEN 'error' THEN 'applog' WHEN 'click' THEN 'unknown' ELSE 'network' END AS format, CASE event_type WHEN 'error' THEN 'objects' ELSE 'lines' END AS shape FROM events GROUP BY event_type")
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format and shape of files that differ by their first characters."""
    b = Q.table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("pid"))
    path, kind = table_path(spark, "formats"), F.col("event_type")
    mark = F.when(kind == "signup", F.to_json(F.struct("pid", F.lit("process_start").alias("event_subtype")))).when(kind == "purchase", F.to_json(F.struct("pid", F.lit("1.1.1.1").alias("local_addr"))))
    mark = mark.when(kind == "error", F.to_json(F.struct("pid", F.lit("x").alias("script_content"), F.lit(1).alias("pattern_hits")), {"pretty": "true"})).when(kind == "click", F.to_json(F.struct("pid")))
    b.select("event_type", F.coalesce(mark, F.to_json(F.struct("pid", F.lit("npcap_live").alias("source")))).alias("value")).write.partitionBy("event_type").text(path)
    return readers.inspected(spark, [path]).select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("name"), "format", "shape").distinct()


def _correlated(spark: SparkSession, sf_dir: str, ids: bool = True) -> api.Correlation:
    paths = _written(spark, sf_dir)
    return api.correlate_files(spark, list(paths.values()), {p: n for n, p in paths.items()}, Q.HOUR, Q.HOUR, Q.HOUR, ("pid", "window", "flow", "script"), delete=True, ids=ids)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled groups alone; their events are gone."""
    return _correlated(spark, sf_dir, ids=False).kept_groups(delete=True)


_EDGES = f"""
{Q._R3}, {Q._R4},
r1 AS (SELECT a, b FROM (SELECT lag(event_id) OVER w AS a, event_id AS b, us - lag(us) OVER w AS d FROM u WHERE pid > 0 WINDOW w AS (PARTITION BY pid ORDER BY us, event_id)) WHERE d <= {Q.HOUR}000000),
r6 AS (SELECT a, b FROM (SELECT p.event_id AS a, s.event_id AS b, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(p.us - s.us), p.us, p.event_id) AS rn FROM (SELECT * FROM u WHERE record_type = 'script_execution') s
  JOIN (SELECT * FROM u WHERE record_type = 'process_start' AND contains(lower(process_name), 'powershell')) p ON abs(p.us - s.us) <= {Q.HOUR}000000) WHERE rn = 1),
e AS (SELECT a, b FROM r1 UNION SELECT a, b FROM r3 UNION SELECT a, b FROM r4 UNION SELECT a, b FROM r6)
"""
_ALL = f"WITH RECURSIVE {_SQL}, {_EDGES.strip()}, {Q.closure('script_content')} "


@query(_ALL + "SELECT corr_type, unique_events, total_occurrences::BIGINT AS total_occurrences, start_us, end_us, round((end_us - start_us) / 1000000.0, 2) AS duration_seconds, source_files, processes, dest_ips, protocols, users FROM assembled")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From JSON lines to assembled groups by four rules; A3."""
    out = Q._flat(_groups(spark, sf_dir))
    return out.select("corr_type", "unique_events", "total_occurrences", "start_us", "end_us", "duration_seconds", "source_files", "processes", "dest_ips", "protocols", "users")


@query(_ALL + "SELECT corr_type, processes, dest_ips, protocols, source_files, sum(total_occurrences)::BIGINT AS total_occurrences, CASE WHEN count(*) > 1 THEN count(*) END AS repeat_count FROM assembled GROUP BY corr_type, processes, dest_ips, protocols, source_files")
def files_to_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From JSON lines to deduplicated groups; A5."""
    return Q._flat(correlate.dedup_groups(_groups(spark, sf_dir))).select("corr_type", "processes", "dest_ips", "protocols", "source_files", "total_occurrences", "repeat_count")


@query(_ALL + "SELECT count(*) AS total_groups, sum(unique_events)::BIGINT AS unique_events, sum(total_occurrences)::BIGINT AS total_events, (SELECT max(hi - lo) FROM (SELECT min(t) AS lo, max(t) AS hi FROM (SELECT start_us AS t FROM assembled UNION ALL SELECT end_us FROM assembled) GROUP BY t // 86400000000)) AS span_us FROM assembled")
def ui_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return aggregates.ui_stats(_groups(spark, sf_dir))


@query(_ALL + "SELECT place, total_occurrences, unique_events, corr_type, processes FROM (SELECT rank() OVER (ORDER BY total_occurrences DESC) AS place, corr_type, processes, unique_events, total_occurrences::BIGINT AS total_occurrences FROM assembled) WHERE place <= 20")
def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2"""
    top = correlate.largest(Q._flat(_groups(spark, sf_dir)), 20)
    return top.select("place", "total_occurrences", "unique_events", "corr_type", "processes")


@query(_ALL + """SELECT corr_type, array_to_string(list_slice(string_split(processes, ','), 1, 2), ',') AS processes, array_to_string(list_slice(string_split(dest_ips, ','), 1, 6), ',') AS dest_ips, total_occurrences::BIGINT AS total_occurrences
FROM assembled WHERE corr_type = 'network_flow' AND contains(lower(concat_ws(' ', corr_type, replace(processes, ',', ' '), replace(dest_ips, ',', ' '), replace(users, ',', ' '))), 'proc5')""")
def group_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, L11"""
    found = aggregates.shortened(aggregates.matching_groups(_groups(spark, sf_dir), "network_flow", "PROC5"))
    return found.select("corr_type", F.array_join("processes", ",").alias("processes"), F.array_join("dest_ips", ",").alias("dest_ips"), "total_occurrences")


def _documents(spark: SparkSession, sf_dir: str) -> str:
    path = table_path(spark, "groups")
    _correlated(spark, sf_dir).write(path, _PACKED, delete=True)
    return path


@query(_ALL + """SELECT (SELECT count(*) FROM u)::BIGINT AS total_events, count(*) AS total_groups, 'applog,legacy,network,process' AS input_files FROM (SELECT DISTINCT corr_type, processes, dest_ips, protocols, source_files FROM assembled)""")
def group_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the written document's meta row."""
    meta = spark.read.schema("total_events long, total_groups long, input_files array<string>").json(f"{_documents(spark, sf_dir)}/meta")
    return meta.withColumn("input_files", F.array_join("input_files", ","))


@query(_ALL + """SELECT corr_type, processes, dest_ips, sum(total_occurrences)::BIGINT AS total_occurrences, (SELECT count(*) FROM u)::BIGINT AS all_events FROM assembled GROUP BY corr_type, processes, dest_ips, protocols, source_files""")
def whole_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the one JSON document, read back by its lines: meta opens it, then come all groups, between commas."""
    path = table_path(spark, "whole")
    _correlated(spark, sf_dir).write_document(path, _PACKED, delete=True)
    lines = spark.read.text(path)
    meta = lines.where(F.col("value").startswith('{"meta":')).select(F.from_json(F.concat("value", F.lit("]}")), "meta struct<total_events: long>")["meta"]["total_events"].alias("all_events"))
    group = F.from_json(F.regexp_replace("value", "^,", ""), "corr_id string, corr_type string, processes array<string>, dest_ips array<string>, total_occurrences long, part int").alias("x")
    rows = lines.where(~F.col("value").startswith('{"meta":') & (F.col("value") != "]}")).select(group).select("x.*").where("part = 0")
    return rows.select("corr_type", F.array_join("processes", ",").alias("processes"), F.array_join("dest_ips", ",").alias("dest_ips"), "total_occurrences").crossJoin(meta)


@query("SELECT before // 20000 AS file, event_id FROM (SELECT event_id, CAST(sum(16 + length(event_id::VARCHAR)) OVER (ORDER BY event_id) - 16 - length(event_id::VARCHAR) AS BIGINT) AS before FROM events)")
def rotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: files of twenty thousand bytes; ids are texts in their lines, as in all events, and go by their numbers."""
    path = table_path(spark, "rotated")
    events = Q.table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), F.col("event_id").cast("string").alias("event_id"))
    writers.write_rotated(events, path, 20_000, ["place"], fields=["event_id"])
    found = spark.read.schema("event_id string, file long").json(path)
    return found.select("file", F.col("event_id").cast("long").alias("event_id"))


_EVENTS = "events_of AS (SELECT component, record_type, process_name, src_ip, dst_ip, dst_port, protocol, min(us) AS us FROM g GROUP BY component, record_type, source, process_name, user_name, src_ip, dst_ip, src_port, dst_port, protocol, direction, script_content)"


@query(_ALL + f", {_EVENTS} SELECT record_type, process_name, src_ip, dst_ip, dst_port, count(*) AS n FROM events_of GROUP BY ALL")
def group_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events nested in parts, written as JSON lines and read back as a threat document; each group's actions are there once."""
    path = table_path(spark, "nested")
    _correlated(spark, sf_dir).write(path, _PACKED, delete=True, per_part=7, merged=False)
    out = readers.threat_events(spark, f"{path}/groups", by_line=True)
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select("record_type", "process_name", text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"), F.col("dst_port").cast("int").alias("dst_port")).groupBy("record_type", "process_name", "src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("n"))


@query(_ALL + ", v AS (SELECT *, contains(lower(processes), 'powershell.exe') AS high FROM assembled) SELECT strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S.') || lpad((start_us // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS timestamp, CASE WHEN high THEN 'High' ELSE 'Low' END AS system_risk_level, high AS critical, unique_events AS raw_events FROM v")
def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of groups as alerts, with their events."""
    found = _correlated(spark, sf_dir)
    judged = enrich.verdicts(found.assembled.withColumn("risk_level", F.lit(None).cast("string")))
    with released(spark):
        nested = found.nested(1_000_000)
    made = writers.alerts(judged, nested)
    return made.select("timestamp", "system_risk_level", (F.col("ai_evaluation") == "CRITICAL").alias("critical"), F.size("raw_events").cast("long").alias("raw_events"))


@query("WITH x AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('8.8.4.', page_id % 250) WHEN page_id % 3 = 1 THEN '10.0.0.1' END AS ip, CASE page_id % 5 WHEN 0 THEN concat('h', page_id % 40) WHEN 1 THEN concat('u', page_id % 40) END AS domain, CASE page_id % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'q' WHEN 2 THEN 'i' ELSE 'unknown' END AS process FROM pages) "
       "SELECT CASE WHEN page_id % 3 = 0 THEN ip END AS ip, domain, process AS process_name, count(*) AS n FROM x WHERE page_id % 3 = 0 OR domain IS NOT NULL GROUP BY ALL")  # fmt: skip
def threat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents; address, domain and process from any of their fields."""
    pages = Q.table(spark, sf_dir, "pages").select("page_id")
    i = F.col("page_id")
    ip = F.when(i % 3 == 0, F.concat(F.lit("8.8.4."), i % 250)).when(i % 3 == 1, "10.0.0.1")
    event = F.struct(
        F.when(i % 2 == 0, ip).alias("ip"), F.when(i % 2 == 1, ip).alias("src_ip"), F.when(i % 5 == 0, F.concat(F.lit("h"), i % 40)).alias("hostname"), F.when(i % 5 == 1, F.concat(F.lit("u"), i % 40)).alias("url"),
        F.when(i % 4 == 0, "p").alias("process_name"), F.when(i % 4 == 1, "q").alias("process"), F.when(i % 4 == 2, "i").alias("image"),
    )
    doc = F.when(i % 3 == 0, F.to_json(F.struct(F.array(event).alias("events")))).when(i % 3 == 1, F.to_json(F.struct(F.struct(F.array(event).alias("list")).alias("deep")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("g").alias("corr_id"), F.array(event).alias("events"))).alias("correlated_groups"))))
    path = table_path(spark, "documents")
    pages.select(doc.alias("value")).unionByName(spark.createDataFrame([("no json",)], "value string")).write.text(path)
    return threat.extracted(readers.threat_events(spark, path, by_line=True)).groupBy("ip", "domain", "process_name").agg(F.count("*").alias("n"))


@query("WITH " + f"raw_events AS ({RAW}), u AS ({UNIFIED.format(string='VARCHAR')}) " + "SELECT record_type, CASE event_id % 3 WHEN 0 THEN 'file_integrity' WHEN 1 THEN 'amsi_monitor' ELSE 'usb_monitor' END AS source, CASE event_id % 3 WHEN 0 THEN nullif(pid, 0) WHEN 1 THEN pid END AS pid, CASE event_id % 3 WHEN 0 THEN concat('c:\\f', k) WHEN 2 THEN 'E:' ELSE '' END AS canonical_path, us - us % CASE event_id % 3 WHEN 0 THEN 1000000 ELSE 1000 END AS us, CASE WHEN event_id % 3 = 1 THEN user_name ELSE '' END AS user_name FROM (SELECT * REPLACE (CASE event_id % 3 WHEN 0 THEN 'file_write' WHEN 1 THEN 'script_execution' ELSE 'usb_session' END AS record_type) FROM u)")
def endpoint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of file, script and device logs, whose times have other names and forms; Q3, Q31."""
    b = unified(spark, sf_dir)
    at = lambda p: F.date_format(F.to_utc_timestamp(F.timestamp_micros("us"), F.current_timezone()), p)
    paths = {n: table_path(spark, n) for n in ("file", "script", "usb")}
    writers.write_lines(writers.with_severity(b.where("event_id % 3 = 0").select(F.lit("file_integrity").alias("endpoint"), F.lit("write").alias("action"), F.concat(F.lit("C:\\f"), "k").alias("path"), "pid", F.col("process_name").alias("process"), at("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")), F.lit("info")), paths["file"])
    script = b.where("event_id % 3 = 1").select(at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.lit("LOW").alias("severity"), F.lit("POWERSHELL").alias("lang"), F.lit("NONE").alias("detection"), F.hex("k").alias("hash"), F.lit("tool.exe").alias("app_name"), F.lit("c").alias("content_name"), F.lit(b"x").alias("content"), "pid", F.col("user_name").alias("user"), (F.col("k") % 2 == 0).alias("is_dedup"))
    log = writers.script_log(script)
    log.select(F.to_json(F.struct(*log.columns)).alias("value")).write.text(paths["script"])
    usb = b.where("event_id % 3 = 2").select(at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.lit("usb_monitor").alias("endpoint"), F.lit("USB_SESSION_END").alias("event_type"), F.lit("E:").alias("mount_point"))
    writers.write_lines(usb, paths["usb"])
    return readers.Normalizers().ingest(spark, list(paths.values())).select("record_type", "source", "pid", "canonical_path", "us", "user_name")


@query("SELECT " + ", ".join(f"'{f.name}' AS c{i}" for i, f in enumerate(schemas.UNIFIED.fields[:3])) + ", doc_id, 'e' || doc_id AS event_id, '' AS user_name, false AS amsi_bypass FROM documents")
def built_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3"""
    from lodewatch.functions.build import EventBuilder

    docs = Q.table(spark, sf_dir, "documents")
    made = EventBuilder(event_id=F.concat(F.lit("e"), "doc_id")).set(pid=F.col("doc_id"), process_name="tool.exe").over(docs)
    return made.select(*(F.lit(f.name).alias(f"c{i}") for i, f in enumerate(schemas.UNIFIED.fields[:3])), F.col("pid").alias("doc_id"), "event_id", "user_name", "amsi_bypass")
