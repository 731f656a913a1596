"""Queries over the standard tables: one for each operator, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.functions import classify, net, text
from lodewatch.functions import tables as T
from lodewatch.operators import aggregates, capture, correlate, enrich, observed, risk, stateful, threat
from lodewatch.plans.registry import ORACLE, query, with_view
from lodewatch.plans.views import table, unified
from lodewatch.shared import written

#: Events are hours apart in these tables, so windows are an hour here.
HOUR = 3600
NEUTRAL_PATTERNS = (("tion", "CAT_A", "LOW"), ("ing ", "CAT_B", "MEDIUM"), ("que ", "CAT_C", "HIGH"), ("###", "CAT_D", "CRITICAL"), ("el ", "CAT_E", "HIGH"))
NEUTRAL_HITS = ("the ", "und ", "les ", "los ", "###", "@", "| ", "!!")
ROOTS = (("http://m.", "SYSTEM"), ("https://www.", "KNOWN_USER"), ("https://", "WEB"))


_GENERIC = ", ".join(f"'{p}'" for p in T.GENERIC_PROCESSES)
_SPECIFIC = f"process_name <> '' AND lower(process_name) NOT IN ({_GENERIC})"


@query(with_view("SELECT event_id, us, record_type, process_name, src_ip, dst_ip, dst_port, direction FROM u"))
def unified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).select("event_id", "us", "record_type", "process_name", "src_ip", "dst_ip", "dst_port", "direction")


@query(with_view("SELECT a, b FROM (SELECT first_value(event_id) OVER (PARTITION BY pid ORDER BY us, event_id) AS a, event_id AS b FROM u WHERE pid > 0) WHERE a <> b"))
def r1_pid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.same_pid(unified(spark, sf_dir))


@query(with_view(f"SELECT a, b FROM (SELECT first_value(event_id) OVER (PARTITION BY lower(process_name) ORDER BY us, event_id) AS a, event_id AS b, min(source_file) OVER (PARTITION BY lower(process_name)) <> max(source_file) OVER (PARTITION BY lower(process_name)) AS wide FROM u WHERE {_SPECIFIC}) WHERE wide AND a <> b"))
def r2_bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.cross_file(unified(spark, sf_dir))


_R3 = f"""
t AS (SELECT event_id, us, lower(process_name) AS name, nullif(src_ip, '') AS ip FROM u WHERE {_SPECIFIC}),
n AS (SELECT *,
  lag(us) OVER own AS us1, lag(event_id) OVER own AS id1,
  last_value(CASE WHEN ip IS NULL THEN us END IGNORE NULLS) OVER bef AS us2, last_value(CASE WHEN ip IS NULL THEN event_id END IGNORE NULLS) OVER bef AS id2,
  first_value(CASE WHEN ip IS NULL THEN us END IGNORE NULLS) OVER aft AS us3, first_value(CASE WHEN ip IS NULL THEN event_id END IGNORE NULLS) OVER aft AS id3
  FROM t WINDOW own AS (PARTITION BY name, ip ORDER BY us, event_id),
  bef AS (PARTITION BY name ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  aft AS (PARTITION BY name ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r3 AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (
  SELECT id1 AS x, event_id AS y FROM n WHERE abs(us - us1) <= {HOUR}000000
  UNION ALL SELECT id2, event_id FROM n WHERE ip IS NOT NULL AND abs(us - us2) <= {HOUR}000000
  UNION ALL SELECT id3, event_id FROM n WHERE ip IS NOT NULL AND abs(us - us3) <= {HOUR}000000))
"""


@query(with_view("SELECT a, b FROM r3", _R3))
def r3_window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.same_window(unified(spark, sf_dir), HOUR)


_R4 = """
f AS (SELECT *, min(direction) OVER w <> max(direction) OVER w AS both_ways, first_value(event_id) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port ORDER BY us, event_id) AS first_id
  FROM u WHERE src_ip <> '' AND dst_ip <> '' WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port)),
r4 AS (SELECT first_id AS a, event_id AS b FROM f WHERE both_ways AND first_id <> event_id)
"""


@query(with_view("SELECT a, b FROM r4", _R4))
def r4_flow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.paired_flow(unified(spark, sf_dir))


@query(with_view(f"SELECT a, b FROM (SELECT first_value(event_id) OVER (PARTITION BY user_name, lower(process_name) ORDER BY us, event_id) AS a, event_id AS b FROM u WHERE user_name <> '' AND {_SPECIFIC}) WHERE a <> b"))
def r5_user_process_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.same_user_process(unified(spark, sf_dir))


@query(with_view(f"""
SELECT a, b, distance_us FROM (
  SELECT p.event_id AS a, s.event_id AS b, abs(p.us - s.us) AS distance_us, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(p.us - s.us), p.us, p.event_id) AS rn
  FROM (SELECT * FROM u WHERE record_type = 'script_execution') s
  JOIN (SELECT * FROM u WHERE record_type = 'process_start' AND contains(lower(process_name), 'powershell')) p ON abs(p.us - s.us) <= {HOUR}000000) WHERE rn = 1
"""))
def r6_nearest_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.nearest_process(unified(spark, sf_dir), HOUR)


_TYPE = """CASE WHEN p AND n AND s THEN 'full_activity_session' WHEN p AND n THEN 'process_with_network' WHEN p AND s THEN 'process_with_script' WHEN n AND s THEN 'network_with_script'
  WHEN p THEN 'process_session' WHEN n THEN 'network_flow' WHEN s THEN 'script_session' ELSE 'mixed' END"""


def closure(*more: str) -> str:
    """SQL tables ``g`` (events with their component) and ``assembled`` from events ``u`` and edges ``e``; more: further columns of an action."""
    some = lambda c, name: f"coalesce(string_agg(DISTINCT nullif({c}, ''), ',' ORDER BY nullif({c}, '')), '') AS {name}"
    action = ", ".join(("component", "record_type", "source", "process_name", "user_name", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", *more))
    return f"""d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, label) AS (SELECT event_id, event_id FROM u UNION SELECT d.b, reach.label FROM reach JOIN d ON d.a = reach.node AND d.b > reach.label),
g AS (SELECT u.*, r.component FROM u JOIN (SELECT node, min(label) AS component FROM reach GROUP BY node) r ON r.node = u.event_id),
actions AS (SELECT component, count(*) AS unique_events FROM (SELECT DISTINCT {action} FROM g) GROUP BY component),
flat AS (SELECT component, count(*) AS total_occurrences, min(us) AS start_us, max(us) AS end_us,
  {some("source_file", "source_files")}, {some("process_name", "processes")}, {some("dst_ip", "dest_ips")}, {some("protocol", "protocols")}, {some("user_name", "users")},
  bool_or(record_type = 'process_start') AS p, bool_or(record_type = 'network_connect') AS n, bool_or(record_type = 'script_execution') AS s FROM g GROUP BY component),
assembled AS (SELECT flat.*, unique_events, {_TYPE} AS corr_type FROM flat JOIN actions USING (component))"""


_ASSEMBLED = f"{_R3}, {_R4}, e AS (SELECT a, b FROM r3 UNION SELECT a, b FROM r4), {closure()}"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = unified(spark, sf_dir)
    return correlate.assign(events, [correlate.same_window(events, HOUR), correlate.paired_flow(events)])


def _flat(groups: DataFrame) -> DataFrame:
    lists = ("source_files", "processes", "dest_ips", "protocols", "users")
    return groups.withColumns({c: F.array_join(c, ",") for c in lists})


@query("WITH RECURSIVE " + with_view("SELECT component, corr_type, unique_events, total_occurrences, start_us, end_us, source_files, processes, dest_ips, protocols, users FROM assembled", _ASSEMBLED)[5:])
def corr_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events linked by window and flow, as assembled groups."""
    return _flat(correlate.assemble(_grouped(spark, sf_dir))).select("component", "corr_type", "unique_events", "total_occurrences", "start_us", "end_us", "source_files", "processes", "dest_ips", "protocols", "users")


@query("WITH RECURSIVE " + with_view("""SELECT corr_type, processes, dest_ips, protocols, source_files, sum(total_occurrences)::BIGINT AS total_occurrences,
  arg_max(component, total_occurrences * 1000000000 - component) AS component, CASE WHEN count(*) > 1 THEN count(*) END AS repeat_count FROM assembled GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY corr_type, processes, dest_ips, protocols, source_files"), _ASSEMBLED)[5:])
def group_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = correlate.assemble(_grouped(spark, sf_dir)).select("component", "corr_type", "processes", "dest_ips", "protocols", "source_files", "users", "total_occurrences")
    return _flat(correlate.dedup_groups(groups)).select("corr_type", "processes", "dest_ips", "protocols", "source_files", "total_occurrences", "component", "repeat_count")


@query("WITH RECURSIVE " + with_view("SELECT corr_type, count(*) AS n, max(total_occurrences) AS largest FROM assembled GROUP BY corr_type", _ASSEMBLED)[5:])
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.assemble(_grouped(spark, sf_dir)).groupBy("corr_type").agg(F.count("*").alias("n"), F.max("total_occurrences").alias("largest"))


@query(with_view("""SELECT pid, record_type, process_name, user_name, src_ip, dst_ip, src_port, dst_port, protocol, direction, count(*) AS n, min(us) AS first_us, max(us) AS last_us, arg_min(event_id, us) AS first_event
FROM u GROUP BY pid, record_type, process_name, user_name, src_ip, dst_ip, src_port, dst_port, protocol, direction"""))
def collapse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.collapse(unified(spark, sf_dir), "pid").drop("source", "script_content")


@query(with_view("""SELECT src_ip, dst_ip, src_port, dst_port, protocol, min(us) AS first_us, max(us) AS last_us, count(*) AS packets,
  coalesce(sum(bytes) FILTER (WHERE direction = 'OUTBOUND'), 0)::BIGINT AS bytes_sent, coalesce(sum(bytes) FILTER (WHERE direction = 'INBOUND'), 0)::BIGINT AS bytes_recv, arg_max(tcp_state, us) AS last_state
FROM u GROUP BY src_ip, dst_ip, src_port, dst_port, protocol"""))
def flow_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.flows(unified(spark, sf_dir))


_USB = """
x AS (SELECT event_id, us, concat('dev', pid % 25) AS session_key, bytes * 1000000 AS size,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'execute' ELSE 'rename' END AS operation,
  concat('E:\\f', k, CASE k % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.PS1' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.jpg' END) AS file_path FROM {u})
"""


def _usb(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _USB.strip().removeprefix("x AS (").removesuffix(")").replace("E:\\", "E:\\\\")
    return spark.sql(sql, u=unified(spark, sf_dir))


_USB_SQL = _USB.format(u="u")


@query(with_view("""SELECT session_key, count(*) FILTER (WHERE operation = 'read') AS reads, count(*) FILTER (WHERE operation = 'write') AS writes, count(*) FILTER (WHERE operation = 'delete') AS deletes, count(*) FILTER (WHERE operation = 'execute') AS executes,
  coalesce(sum(size) FILTER (WHERE operation = 'read'), 0)::BIGINT AS bytes_read, coalesce(sum(size) FILTER (WHERE operation = 'write'), 0)::BIGINT AS bytes_written, max(us) - min(us) AS duration_us,
  count(*) FILTER (WHERE lower(file_path) LIKE '%.ps1') AS n_ps1, count(*) FILTER (WHERE NOT contains(file_path, '.')) AS n_none FROM x GROUP BY session_key""", _USB_SQL))
def usb_session_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = lambda e: F.coalesce(F.try_element_at("file_extensions", F.lit(e)), F.lit(0)).cast("long")
    out = aggregates.usb_sessions(_usb(spark, sf_dir))
    return out.select("session_key", "reads", "writes", "deletes", "executes", "bytes_read", "bytes_written", (F.col("end_us") - F.col("start_us")).alias("duration_us"), ext(".ps1").alias("n_ps1"), ext("(none)").alias("n_none"))


@query(with_view("""SELECT session_key, anomaly, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_key, once ORDER BY us, event_id) AS rn FROM (
  SELECT session_key, us, event_id, 'executable_written: ' || file_path AS once, 'executable_written: ' || file_path AS anomaly FROM x WHERE operation = 'write' AND (lower(file_path) LIKE '%.exe' OR lower(file_path) LIKE '%.ps1')
  UNION ALL SELECT session_key, us, event_id, 'high_read_volume', 'high_read_volume: ' || (t // 1048576) || ' MB read' FROM (SELECT *, sum(size) OVER (PARTITION BY session_key ORDER BY us, event_id)::BIGINT AS t FROM x WHERE operation = 'read') WHERE t >= 524288000
  UNION ALL SELECT session_key, us, event_id, 'high_write_volume', 'high_write_volume: ' || (t // 1048576) || ' MB written' FROM (SELECT *, sum(size) OVER (PARTITION BY session_key ORDER BY us, event_id)::BIGINT AS t FROM x WHERE operation = 'write') WHERE t >= 524288000
  UNION ALL SELECT session_key, us, event_id, 'mass_deletion', 'mass_deletion: ' || t || ' files deleted' FROM (SELECT *, count(*) OVER (PARTITION BY session_key ORDER BY us, event_id) AS t FROM x WHERE operation = 'delete') WHERE t >= 50)) WHERE rn = 1""", _USB_SQL))
def usb_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.usb_anomalies(_usb(spark, sf_dir))


_FILES = "SELECT event_id, us, concat('key', pid) AS file_key, concat('dir', k % 12) AS directory, pid, event_type = 'error' AS elevated, CASE event_type WHEN 'purchase' THEN {close} WHEN 'signup' THEN {delete} WHEN 'error' THEN {write} WHEN 'view' THEN {write} ELSE {write} END AS action FROM {u}"


def _files(spark: SparkSession, sf_dir: str, close: str, delete: str, write: str) -> DataFrame:
    sql = _FILES.replace("{close}", f"'{close}'").replace("{delete}", f"'{delete}'").replace("{write}", f"'{write}'")
    return spark.sql(sql, u=unified(spark, sf_dir))


@query(with_view("""SELECT file_key, write_count, first_us, last_us, flushed_by FROM (
  SELECT w.file_key, w.episode, session, count(*) AS write_count, min(us) AS first_us, max(us) AS last_us,
    CASE WHEN session < any_value(last_session) THEN 'stale' ELSE coalesce(any_value(c.action), 'stale') END AS flushed_by
  FROM (SELECT *, max(session) OVER (PARTITION BY file_key, episode) AS last_session FROM (SELECT *, sum(far) OVER (PARTITION BY file_key, episode ORDER BY us, event_id) AS session FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY file_key, episode ORDER BY us, event_id) > 36000000000 THEN 1 ELSE 0 END AS far FROM ep WHERE action = 'write'))) w
  LEFT JOIN (SELECT file_key, episode, action FROM ep WHERE action <> 'write') c ON c.file_key = w.file_key AND c.episode = w.episode GROUP BY w.file_key, w.episode, session) WHERE flushed_by <> 'delete'""",
  "ep AS (SELECT *, coalesce(sum(CASE WHEN action <> 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY file_key ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM (" + _FILES.format(close="'close'", delete="'delete'", write="'write'", u="u") + "))"))
def write_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coalesced_writes(_files(spark, sf_dir, "close", "delete", "write"), "file_key", 36000)


@query(with_view("""SELECT directory, pid, session::BIGINT AS session, count(*) FILTER (WHERE action = 'create') AS total_created, count(*) FILTER (WHERE action = 'delete') AS total_deleted, count(*) FILTER (WHERE elevated) AS elevated_count, min(us) AS first_us, max(us) AS last_us
FROM (SELECT *, sum(far) OVER (PARTITION BY directory, pid ORDER BY us, event_id) AS session FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY directory, pid ORDER BY us, event_id) > 360000000000 THEN 1 ELSE 0 END AS far FROM fl)) GROUP BY directory, pid, session""",
  "fl AS (" + _FILES.format(close="'delete'", delete="'create'", write="'write'", u="u") + ")"))
def temp_bucket_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.temp_buckets(_files(spark, sf_dir, "delete", "create", "write"), idle_s=360000)


@query(with_view(f"SELECT directory, us // {HOUR}000000 * {HOUR}000000 AS window_us, count(*) AS n FROM (SELECT us, concat('dir', k % 12) AS directory FROM u) GROUP BY 1, 2 HAVING count(*) >= 3"))
def dir_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.churning(unified(spark, sf_dir).withColumn("directory", F.concat(F.lit("dir"), F.col("k") % 12)), "directory", HOUR, 3)


def _recursive(reach: int) -> str:
    return "WITH RECURSIVE " + with_view("", f"""o AS (SELECT event_id, pid, us, row_number() OVER (PARTITION BY pid ORDER BY us, event_id) AS rn FROM u),
a(event_id, pid, us, rn, anchor_us, nth) AS (SELECT event_id, pid, us, rn, us, CAST(1 AS BIGINT) FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.pid, o.us, o.rn, CASE WHEN o.us - a.anchor_us < {reach} THEN a.anchor_us ELSE o.us END, CASE WHEN o.us - a.anchor_us < {reach} THEN a.nth + 1 ELSE 1 END
  FROM a JOIN o ON o.pid = a.pid AND o.rn = a.rn + 1)""")[5:]


@query(_recursive((86400 + 1) * 1_000_000) + "SELECT event_id, CASE WHEN nth = 1 THEN 'FORWARD' ELSE 'COMPRESS' END AS decision, anchor_us, nth FROM a")
def anchored_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.dedup_decisions(unified(spark, sf_dir).select("event_id", "pid", "us"), ["pid"], 86400).select("event_id", "decision", "anchor_us", "nth")


@query(_recursive((86400 + 1) * 1_000_000) + "SELECT pid, anchor_us, max(nth) AS repeat_count, max(us) AS last_us FROM a GROUP BY pid, anchor_us HAVING max(nth) >= 2")
def compress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.compress_summaries(stateful.dedup_decisions(unified(spark, sf_dir).select("event_id", "pid", "us"), ["pid"], 86400), ["pid"])


@query(_recursive(HOUR * 1_000_000) + "SELECT event_id, pid, us FROM a WHERE nth = 1")
def duplicate_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.suppressed(unified(spark, sf_dir).select("event_id", "pid", "us"), ["pid"], HOUR).select("event_id", "pid", "us")


@query(with_view("SELECT event_id, row_number() OVER (PARTITION BY process_name, dst_ip ORDER BY us, event_id) = 1 AS novel FROM u"))
def novelty_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.first_seen(unified(spark, sf_dir), ["process_name", "dst_ip"]).select("event_id", "novel")


@query("SELECT doc_id, sha256(text) AS content_hash, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 THEN 'FULL' ELSE 'DEDUP' END AS shape FROM documents")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return stateful.first_seen(docs, ["content_hash"], ["doc_id"]).select("doc_id", "content_hash", F.when(F.col("novel"), "FULL").otherwise("DEDUP").alias("shape"))


def _starts_sql(names: str) -> str:
    return f"SELECT event_id, us, pid, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE 'other' END AS kind, {names} FROM u"


@query(with_view("""SELECT event_id, parent_pid, kind, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER w::BIGINT AS child_count, sum(CASE WHEN kind = 'start' AND rn = 1 THEN 1 ELSE 0 END) OVER w::BIGINT AS unique_children FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_pid, life, kind, child_name ORDER BY us, event_id) AS rn FROM (SELECT *, sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY parent_pid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS life FROM c))
WINDOW w AS (PARTITION BY parent_pid, life ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""".replace(" OVER w::BIGINT", " OVER w"), "c AS (" + _starts_sql("pid AS parent_pid, process_name AS child_name") + ")").replace("sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER w", "CAST(sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER w AS BIGINT)").replace("sum(CASE WHEN kind = 'start' AND rn = 1 THEN 1 ELSE 0 END) OVER w", "CAST(sum(CASE WHEN kind = 'start' AND rn = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT)"))
def child_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = unified(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").otherwise("other"))
    return aggregates.child_counts(events.select("event_id", "us", "kind", F.col("pid").alias("parent_pid"), F.col("process_name").alias("child_name"))).select("event_id", "parent_pid", "kind", "child_count", "unique_children")


@query(with_view("""SELECT event_id, pid, path, start_us, us - start_us AS lifetime_us FROM (SELECT *, last_value(CASE WHEN kind = 'start' THEN path0 END IGNORE NULLS) OVER w AS path, last_value(CASE WHEN kind = 'start' THEN us END IGNORE NULLS) OVER w AS start_us FROM (
  SELECT *, coalesce(sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM c)
WINDOW w AS (PARTITION BY pid, life ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 'stop'""", "c AS (" + _starts_sql("concat('c:/', process_name) AS path0") + ")"))
def stop_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = unified(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").otherwise("other"))
    return aggregates.stop_identity(events.select("event_id", "us", "pid", "kind", F.concat(F.lit("c:/"), "process_name").alias("path")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_MATCH = "list_max([" + ", ".join(f"CASE WHEN contains(lower(text), {_quoted(p)}) THEN {T.SCRIPT_SEVERITIES.index(s) * 100 - i} END" for i, (p, _, s) in enumerate(NEUTRAL_PATTERNS)) + "])"
_MATCH_ALL = "list_max([" + ", ".join(f"CASE WHEN contains(lower(text), {_quoted(p)}) THEN {T.SCRIPT_SEVERITIES.index(s) * 100 - i} END" for i, (p, _, s) in enumerate(T.SCRIPT_PATTERNS)) + "])"


def _categories(patterns: tuple, match: str) -> str:
    cases = " ".join(f"WHEN {T.SCRIPT_SEVERITIES.index(s) * 100 - i} THEN '{c}'" for i, (_, c, s) in enumerate(patterns))
    severities = " ".join(f"WHEN {T.SCRIPT_SEVERITIES.index(s) * 100 - i} THEN '{s}'" for i, (_, _, s) in enumerate(patterns))
    return f"SELECT doc_id, CASE m {cases} ELSE 'NONE' END AS category, CASE m {severities} ELSE 'INFO' END AS severity FROM (SELECT doc_id, {match} AS m FROM documents)"


def _script_category(spark: SparkSession, sf_dir: str, patterns: tuple) -> DataFrame:
    m = classify.script_match(F.col("text"), patterns)
    docs = table(spark, sf_dir, "documents").select("doc_id", m.alias("m"))
    severity = classify.script_severity(F.col("m"), F.lit("POWERSHELL"), F.lit("user"))
    return docs.select("doc_id", F.coalesce("m.category", F.lit("NONE")).alias("category"), classify.label(severity, T.SCRIPT_SEVERITIES).alias("severity"))


@query(_categories(NEUTRAL_PATTERNS, _MATCH))
def script_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_category(spark, sf_dir, NEUTRAL_PATTERNS)


@query("SELECT doc_id, CASE WHEN category IN ('AMSI_BYPASS', 'RANSOMWARE') THEN 'CRITICAL' ELSE severity END AS severity, category FROM (" + _categories(T.SCRIPT_PATTERNS, _MATCH_ALL) + ")")
def script_category_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_category(spark, sf_dir, T.SCRIPT_PATTERNS).select("doc_id", "severity", "category")


@query("SELECT doc_id, " + " + ".join(f"contains(lower(text), {_quoted(p)})::INT" for p in NEUTRAL_HITS) + " AS hits, " + " + ".join(f"contains(lower(text), {_quoted(p)})::INT" for p in T.HIT_PATTERNS) + " AS default_hits, " + ", ".join("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f") AS {name}" for name, words in T.SCRIPT_FLAGS.items()) + ", contains(lower(text), 'win32_process') AND (contains(lower(text), 'create') OR contains(lower(text), 'cmd')) AS wmi FROM documents")
def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", classify.pattern_hits(t, NEUTRAL_HITS).alias("hits"), classify.pattern_hits(t).alias("default_hits"), *(c.alias(n) for n, c in classify.script_flags(t).items()), classify.wmi_injection(t).alias("wmi"))


_B64 = "regexp_replace({x}, '[A-Za-z0-9+/]{{40,}}={{0,2}}', '[BASE64_BLOB]', 'g')"
_CONCAT = "regexp_replace({x}, '\"([^\"]+)\"\\s*\\+\\s*\"([^\"]+)\"', '\"\\1\\2\"', 'g')"


@query("SELECT doc_id, sha256(" + _CONCAT.format(x=_CONCAT.format(x=_CONCAT.format(x=_B64.format(x="replace(text, chr(96), '')")))) + ") AS clean_hash, contains(" + _B64.format(x="text") + ", '[BASE64_BLOB]') AS had_blob FROM documents")
def deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.deobfuscated(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("clean_hash"), clean.contains("[BASE64_BLOB]").alias("had_blob"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html || ' ' || url, 'https?://[^\\s\"''<>\\]]+'), ' | ') AS urls FROM pages")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.urls(F.concat("html", F.lit(" "), "url")).alias("urls"))


_PUBLIC = "NOT (dst_ip LIKE '192.168.%' OR dst_ip LIKE '10.%')"


@query(with_view(f"SELECT event_id, {_PUBLIC} AS dst_public, false AS src_public FROM u"))
def public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).select("event_id", net.is_public_ipv4(F.col("dst_ip")).alias("dst_public"), net.is_public_ipv4(F.col("src_ip")).alias("src_public"))


_TARGETS = f"""
t0 AS (SELECT *, CASE WHEN {_PUBLIC} THEN dst_ip END AS ip, nullif(domain, '') AS dom FROM u),
t1 AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us, event_id) AS ri, row_number() OVER (PARTITION BY dom ORDER BY us, event_id) AS rd FROM t0 WHERE ip IS NOT NULL OR dom IS NOT NULL),
tg AS (SELECT * FROM t1 WHERE NOT (dom IS NULL AND ri > 1) AND NOT (ip IS NULL AND rd > 1))
"""


@query(with_view("SELECT event_id, ip, dom AS domain FROM tg", _TARGETS))
def ip_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.targets(unified(spark, sf_dir)).select("event_id", "ip", "domain")


_SCORED = f"""
{_TARGETS},
rep AS (SELECT DISTINCT dst_ip AS ip, k * 7 % 101 AS abuse, k % 5 AS mal, k % 3 AS sus FROM u WHERE event_id IN (SELECT min(event_id) FROM u GROUP BY dst_ip)),
rd AS (SELECT DISTINCT domain AS dom, k % 6 AS mal, k % 4 AS sus FROM u WHERE domain <> '' AND event_id IN (SELECT min(event_id) FROM u WHERE domain <> '' GROUP BY domain)),
raw AS (SELECT tg.*, coalesce(rep.abuse, 0) * 6 + (coalesce(rep.mal, 0) + coalesce(rd.mal, 0)) * 120 + (coalesce(rep.sus, 0) + coalesce(rd.sus, 0)) * 40 AS tenths FROM tg LEFT JOIN rep USING (ip) LEFT JOIN rd USING (dom)),
sc AS (SELECT *, least(tenths // 10 + CASE WHEN tenths % 10 > 5 OR tenths % 10 = 5 AND tenths // 10 % 2 = 1 THEN 1 ELSE 0 END, 100)::INT AS risk_score FROM raw),
scored AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' WHEN risk_score >= 20 THEN 'LOW' ELSE 'CLEAN' END AS severity, risk_score > 20 AS is_suspicious FROM sc)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = unified(spark, sf_dir)
    first = lambda key: events.where(F.col(key) != "").groupBy(key).agg(F.min_by("k", "event_id").alias("k"))
    k = F.col("k")
    ips = first("dst_ip").select(F.col("dst_ip").alias("ip"), (k * 7 % 101).alias("abuse_score"), (k % 5).alias("malicious_count"), (k % 3).alias("suspicious_count"))
    domains = first("domain").select(F.col("domain").alias("target"), (k % 6).alias("malicious_count"), (k % 4).alias("suspicious_count"))
    reputation = ips.select(F.col("ip").alias("target"), "malicious_count", "suspicious_count").unionByName(domains)
    return threat.scored(threat.targets(events), ips, reputation)


@query(with_view("SELECT event_id, ip, dom AS domain, risk_score, severity, is_suspicious FROM scored", _SCORED))
def threat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", "ip", "domain", "risk_score", "severity", "is_suspicious")


@query(with_view("SELECT count(*) AS total, count(*) FILTER (WHERE is_suspicious) AS suspicious, count(*) FILTER (WHERE NOT is_suspicious) AS clean_rows, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in threat.COLORS) + " FROM scored", _SCORED))
def threat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.summary(_scored(spark, sf_dir))


@query(with_view("SELECT event_id, risk_score, severity FROM scored ORDER BY risk_score DESC, event_id LIMIT 5", _SCORED))
def top_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.top(_scored(spark, sf_dir)).select("event_id", "risk_score", "severity")


_LABEL = "CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' WHEN risk_score >= 20 THEN 'LOW' ELSE 'CLEAN' END AS severity"


@query(with_view(f"""SELECT node_id, kind, risk_score, {_LABEL} FROM (
  SELECT 'process::' || process_name AS node_id, 'process' AS kind, max(risk_score) AS risk_score FROM scored GROUP BY process_name
  UNION ALL SELECT 'ip::' || ip, 'ip', max(risk_score) FROM scored WHERE ip IS NOT NULL GROUP BY ip
  UNION ALL SELECT 'domain::' || dom, 'domain', arg_min(risk_score, us) FROM scored WHERE dom IS NOT NULL GROUP BY dom)""", _SCORED))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.graph_nodes(_scored(spark, sf_dir))


@query(with_view("""SELECT 'process::' || process_name AS source, 'ip::' || ip AS target, protocol || ' :' || dst_port AS label, event_id FROM scored WHERE ip IS NOT NULL
  UNION ALL SELECT 'process::' || process_name, 'domain::' || dom, protocol || ' :' || dst_port, event_id FROM scored WHERE dom IS NOT NULL""", _SCORED))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.graph_edges(_scored(spark, sf_dir))


@query("SELECT doc_id, substr(regexp_replace(lower(substr(text, 1, 4096)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 256) AS command FROM documents")
def command_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized_command(F.col("text")).alias("command"))


@query("SELECT page_id, regexp_extract(url, '[^\\\\/]*$') AS base, lower(regexp_extract(url, '\\.[^.\\\\/]*$')) AS ext FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"), text.extension(F.col("url")).alias("ext"))


@query("SELECT page_id, CASE WHEN starts_with(lower(url), 'https://www.') THEN 'KNOWN_USER' WHEN starts_with(lower(url), 'http://m.') THEN 'SYSTEM' WHEN starts_with(lower(url), 'https://') THEN 'WEB' ELSE 'UNKNOWN' END AS location FROM pages")
def location_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", classify.location(F.col("url"), ROOTS).alias("location"))


@query(with_view("""SELECT event_id, CASE WHEN k % 9 = 0 THEN 2 WHEN place = 'UNKNOWN' THEN 1 ELSE
  CASE WHEN k % 2 = 1 THEN 4 ELSE 0 END + CASE WHEN k % 2 = 0 AND place = 'SYSTEM' AND k % 3 <> 0 THEN 8 ELSE 0 END + CASE WHEN lower(process_name) IN ('svchost.exe', 'powershell.exe') AND place <> 'SYSTEM' THEN 16 ELSE 0 END
  + CASE WHEN pid % 7 = 0 THEN 32 ELSE 0 END + CASE WHEN pid % 11 = 0 THEN 64 ELSE 0 END + CASE WHEN pid % 13 = 0 THEN 128 ELSE 0 END + CASE WHEN rel = 1 THEN 512 ELSE 0 END + CASE WHEN proc = 1 THEN 1024 ELSE 0 END END AS rules FROM r""",
  "r AS (SELECT *, CASE k % 4 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'KNOWN_USER' WHEN 2 THEN 'SYSTEM' ELSE 'UNKNOWN' END AS place, row_number() OVER (PARTITION BY user_name, process_name ORDER BY us, event_id) AS rel, row_number() OVER (PARTITION BY process_name ORDER BY us, event_id) AS proc FROM u)"))
def forward_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stateful.first_seen(unified(spark, sf_dir), ["user_name", "process_name"]).withColumnRenamed("novel", "rel")
    events = stateful.first_seen(events, ["process_name"])
    k, pid = F.col("k"), F.col("pid")
    row = {
        "location": F.when(k % 4 == 1, "KNOWN_USER").when(k % 4 == 3, "UNKNOWN").otherwise("SYSTEM"), "path": F.when(k % 9 == 0, "").otherwise("c:\\x"), "signed": k % 2 == 0,
        "signer": F.when(k % 3 == 0, "Microsoft Windows").otherwise("Other"), "name": F.col("process_name"), "new_child": pid % 7 == 0, "dll_unknown": pid % 11 == 0, "shadowing": pid % 13 == 0,
        "new_relationship": F.col("rel"), "new_process": F.col("novel"),
    }
    return events.select("event_id", classify.forward_rules(row).alias("rules"))


@query("SELECT doc_id, CASE WHEN doc_id IN (3, 5) THEN true WHEN contains(source, 'src1') THEN false WHEN lang IN ('de') THEN false WHEN m IS NULL THEN false ELSE m >= 250 END AS logged FROM (SELECT doc_id, source, lang, " + _MATCH + " AS m FROM documents)")
def script_log_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("m", classify.script_match(F.col("text"), NEUTRAL_PATTERNS))
    language = F.when(F.col("lang") == "de", "PYTHON").otherwise("POWERSHELL")
    severity = classify.script_severity(F.col("m"), language, F.lit("user"))
    return docs.select("doc_id", classify.should_log(severity, F.col("doc_id"), F.col("source"), language, F.lit(False), (3, 5), ("SRC1",), False, False, True, 3).alias("logged"))


@query(with_view("SELECT max(hi - lo) AS max_daily_span_us, count(*) AS days FROM (SELECT us // 86400000000 AS day, min(us) AS lo, max(us) AS hi FROM u GROUP BY 1)"))
def daily_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = unified(spark, sf_dir).groupBy(F.floor(F.col("us") / 86_400_000_000)).agg((F.max("us") - F.min("us")).alias("span"))
    return days.agg(F.max("span").alias("max_daily_span_us"), F.count("*").alias("days"))


@query(with_view("SELECT pid, n, round((5 + sqrt(n::DOUBLE / max(n) OVER ()) * 14) * 1000)::BIGINT AS radius_milli FROM (SELECT pid, count(*) AS n FROM u GROUP BY pid)"))
def timeline_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = unified(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most)).select("pid", "n", F.round((5 + F.sqrt(F.col("n") / F.col("most")) * 14) * 1000).cast("long").alias("radius_milli"))


_PATHS = "CASE page_id % 6 WHEN 0 THEN 'c:\\windows\\system32\\a' WHEN 1 THEN 'c:\\startup\\a' WHEN 2 THEN 'c:\\temp\\a' ELSE 'd:\\data\\a' END || CASE page_id % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.txt' WHEN 2 THEN '.js' WHEN 3 THEN '.log' ELSE '' END"
_STARTUP, _PROTECTED, _TEMP = ("C:\\Startup",), ("C:\\Windows\\System32",), ("C:\\Temp",)


@query(f"""SELECT page_id, CASE WHEN page_id % 7 = 4 THEN 'DROP' WHEN page_id % 6 IN (0, 1) OR page_id % 5 IN (0, 2) THEN 'A' WHEN page_id % 6 = 2 THEN 'B' ELSE 'C' END AS route,
CASE WHEN page_id % 4 = 3 THEN CASE page_id % 6 WHEN 1 THEN 'CRITICAL' WHEN 0 THEN 'ALERT' ELSE 'INFO' END
  WHEN page_id % 6 = 1 THEN 'CRITICAL' WHEN page_id % 5 IN (0, 2) AND page_id % 6 = 0 THEN 'CRITICAL' WHEN page_id % 6 = 0 AND page_id % 3 = 0 AND page_id % 9 = 0 THEN 'CRITICAL'
  WHEN page_id % 5 IN (0, 2) AND page_id % 4 IN (0, 1) THEN 'WARNING' WHEN page_id % 6 = 0 THEN 'WARNING'
  WHEN page_id % 5 = 1 AND page_id % 4 IN (0, 2) AND page_id % 9 = 0 THEN 'ALERT' WHEN page_id % 5 = 2 THEN 'ALERT' ELSE 'INFO' END AS severity FROM (SELECT page_id, {_PATHS} AS path FROM pages)""")
def file_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS.replace("\\", "\\\\")).alias("path"))
    i = F.col("page_id")
    action = F.when(i % 4 == 0, "write").when(i % 4 == 1, "create").when(i % 4 == 2, "delete").otherwise("set_info")
    process = F.when(i % 9 == 0, "PowerShell.exe").otherwise("tool.exe")
    path = F.when(i % 7 == 4, "").otherwise(F.col("path"))
    return pages.select("page_id", classify.file_route(path, _STARTUP, _PROTECTED, _TEMP).alias("route"), classify.label(classify.file_severity(action, F.col("path"), process, _STARTUP, _PROTECTED), T.FILE_SEVERITIES).alias("severity"))


@query(with_view("SELECT event_id, CASE WHEN dst_port = 9999 THEN CASE WHEN src_port = 50003 THEN 'UNKNOWN' ELSE 'UNKNOWN' END ELSE protocol END AS layer, CASE WHEN src_ip LIKE '10.0.%' AND dst_ip NOT LIKE '192.168.%' THEN 'OUTBOUND' ELSE 'INBOUND' END AS flow_direction, CASE k % 4 WHEN 0 THEN 'SYN_SENT' WHEN 1 THEN 'SYN_RECEIVED' WHEN 2 THEN 'CLOSED' ELSE 'ESTABLISHED' END AS state, dst_ip LIKE '%.255' AS is_broadcast FROM u"))
def flow_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = unified(spark, sf_dir)
    flags = F.when(F.col("k") % 4 == 0, 2).when(F.col("k") % 4 == 1, 18).when(F.col("k") % 4 == 2, 17).otherwise(16)
    return events.select("event_id", net.layer_by_port(F.col("dst_port"), F.col("src_port")).alias("layer"), net.direction(F.col("src_ip").startswith("10.0."), F.col("dst_ip").startswith("192.168."), F.lit(False)).alias("flow_direction"), net.tcp_state(flags).alias("state"), net.is_broadcast(F.col("dst_ip")).alias("is_broadcast"))


@query(with_view("SELECT event_id, sha256(concat('c:/', process_name, chr(0), user_name, chr(0), substr(concat('run ', k), 1, 256), chr(0), '', chr(0), 'SYSTEM')) AS fingerprint FROM u"))
def process_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).select("event_id", text.fingerprint(F.concat(F.lit("c:/"), "process_name"), F.col("user_name"), F.concat(F.lit("run "), "k"), F.lit(None).cast("string"), F.lit("SYSTEM")).alias("fingerprint"))


@query(_recursive((86400 + 1) * 1_000_000) + "SELECT count(*) AS total, count(*) FILTER (WHERE nth = 1) AS forwarded, count(*) FILTER (WHERE nth > 1) AS compressed, count(*) FILTER (WHERE nth > 1) * 100 // count(*) AS ratio FROM a")
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stateful.dedup_decisions(unified(spark, sf_dir).select("event_id", "pid", "us"), ["pid"], 86400)
    return made.agg(F.count("*").alias("total"), F.count_if("forwarded").alias("forwarded"), F.count_if(~F.col("forwarded")).alias("compressed")).withColumn("ratio", F.expr("compressed * 100 div total"))


@query(ORACLE["pipeline_counters"])
def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters, seen while the decisions are written."""
    made = stateful.dedup_decisions(unified(spark, sf_dir).select("event_id", "pid", "us"), ["pid"], 86400)
    rows, seen = observed.counted(made, observed.decision_counts())
    written(rows, "decisions")
    return spark.createDataFrame([tuple(seen.get[c] for c in ("total", "forwarded", "compressed"))], "total long, forwarded long, compressed long").withColumn("ratio", F.expr("compressed * 100 div total"))


_LEVELS = "h AS (SELECT *, (('0x' || substr(md5(component::VARCHAR), 1, 8))::BIGINT) % 12 AS b, contains(lower(processes), 'powershell.exe') AS shell, corr_type = 'network_flow' AS flow FROM assembled)"


@query("WITH RECURSIVE " + with_view("""SELECT component, CASE WHEN shell THEN 'High' WHEN flow THEN 'Medium' ELSE 'Low' END AS risk,
  CASE WHEN shell OR total_occurrences >= 5 THEN 'CRITICAL' WHEN flow THEN list_extract(['Medium', 'Above Medium', 'High'], (b % 3 + 1)::INT) ELSE list_extract(['Low', 'Low', 'Medium', 'Above Medium'], (b % 4 + 1)::INT) END AS threat_level FROM h""", f"{_ASSEMBLED}, {_LEVELS}")[5:])
def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of groups' verdicts; the model's place is taken by a count."""
    groups = correlate.assemble(_grouped(spark, sf_dir)).withColumn("risk_level", F.when(F.col("corr_type") == "network_flow", "Medium"))
    return enrich.verdicts(groups, lambda g: g["total_occurrences"] >= 5).select("component", "risk", "threat_level")


@query("WITH RECURSIVE " + with_view("""SELECT component, round(ln(1 + total_occurrences), 6) AS log_occurrences, round(ln(1 + unique_events), 6) AS log_actions, round(ln(1 + (end_us - start_us) / 1000000.0), 6) AS log_seconds,
  CASE WHEN processes = '' THEN 0 ELSE len(string_split(processes, ',')) END::DOUBLE AS n_processes, CASE WHEN dest_ips = '' THEN 0 ELSE len(string_split(dest_ips, ',')) END::DOUBLE AS n_addresses, s::INT::DOUBLE AS has_script, true AS same, true AS sure FROM assembled""", _ASSEMBLED)[5:])
def group_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of groups, and a model trained on them: its score by the pipeline and by plain arithmetic are one, and tell script groups apart."""
    groups = written(correlate.assemble(_grouped(spark, sf_dir)), "groups")
    model = risk.Model.trained(groups.withColumn("bad", F.array_contains("record_types", "script_execution")), "bad")
    out = model.scored(groups)
    featured = risk.with_features(out)
    number = lambda c: F.round(c, 6).alias(c)
    sure = (F.col("risk_score") > 0.5) == (F.col("has_script") > 0)
    return featured.select("component", *map(number, ("log_occurrences", "log_actions", "log_seconds")), "n_processes", "n_addresses", "has_script", (F.abs(F.col("risk_score") - model.score()) < 1e-9).alias("same"), sure.alias("sure"))


@query(with_view("SELECT event_id, process_name, dst_ip FROM u WHERE record_type = 'network_connect' AND contains(lower(concat_ws(' ', event_id, record_type, process_name, dst_ip, user_name)), 'user1')"))
def ui_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lower(F.concat_ws(" ", "event_id", "record_type", "process_name", "dst_ip", "user_name"))
    return unified(spark, sf_dir).where((F.col("record_type") == "network_connect") & said.contains("user1")).select("event_id", "process_name", "dst_ip")


@query(with_view("SELECT pid, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' END AS lasted FROM (SELECT pid, (max(us) - min(us)) // 1000000 % 10000 AS s FROM u GROUP BY pid)"))
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = unified(spark, sf_dir).groupBy("pid").agg((F.floor((F.max("us") - F.min("us")) / 1_000_000) % 10000).alias("s"))
    return spans.select("pid", text.duration(F.col("s")).alias("lasted"))


@query(with_view("SELECT pid, source_file, event_type, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM u GROUP BY ROLLUP (pid, source_file, event_type)"))
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).rollup("pid", "source_file", "event_type").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(with_view("SELECT event_id, CASE k % 8 + 12 WHEN 12 THEN 'create' WHEN 13 THEN 'close' WHEN 14 THEN 'close' WHEN 15 THEN 'read' WHEN 16 THEN 'write' WHEN 17 THEN 'set_info' WHEN 18 THEN 'delete' ELSE 'rename' END AS action, CASE k % 5 + 1 WHEN 2 THEN 'delete' WHEN 4 THEN 'rename' WHEN 5 THEN NULL ELSE 'write' END AS operation FROM u"))
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return unified(spark, sf_dir).select("event_id", capture.file_action(k % 8 + 12).alias("action"), capture.watcher_operation(k % 5 + 1).alias("operation"))


@query(with_view("""SELECT event_id, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY pid, epoch ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 'unresolved') AS path FROM (
  SELECT event_id, us, pid, CASE WHEN k % 4 = 0 THEN concat('c:/f', k) END AS p, coalesce(sum(CASE WHEN k % 8 IN (2, 6) THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM u)"""))
def path_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    events = unified(spark, sf_dir).select("event_id", "us", F.col("pid").alias("file_key"), (k % 8 + 12).alias("opcode"), F.when(k % 4 == 0, F.concat(F.lit("c:/f"), "k")).alias("path"))
    return capture.resolved_paths(events).select("event_id", "path")


@query(with_view("""SELECT event_id, device, session FROM (SELECT *, CAST(sum(CASE WHEN kind = 'arrival' AND coalesce(before_kind, 'removal') = 'removal' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM (SELECT *, last_value(CASE WHEN kind <> 'io' THEN kind END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_kind, last_value(CASE WHEN kind <> 'io' THEN kind END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_kind
  FROM (SELECT event_id, us, pid AS device, CASE event_type WHEN 'signup' THEN 'arrival' WHEN 'purchase' THEN 'removal' ELSE 'io' END AS kind FROM u) WINDOW w AS (PARTITION BY device ORDER BY us, event_id)))
WHERE last_kind = 'arrival' OR (kind = 'removal' AND before_kind = 'arrival')""".replace("OVER (w ROWS", "OVER (PARTITION BY device ORDER BY us, event_id ROWS").replace(" WINDOW w AS (PARTITION BY device ORDER BY us, event_id)", "")))
def device_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "arrival").when(F.col("event_type") == "purchase", "removal").otherwise("io")
    return capture.device_sessions(unified(spark, sf_dir).select("event_id", "us", F.col("pid").alias("device"), kind.alias("kind"))).select("event_id", "device", "session")


@query(with_view("""SELECT e.event_id, coalesce(s.pid, 0) AS owner FROM (SELECT * FROM u WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT src_port, k % 3 AS proto, us, max(pid) AS pid FROM u WHERE event_type = 'signup' GROUP BY ALL) s
  ON e.src_port = s.src_port AND e.k % 3 = s.proto AND e.us >= s.us""".replace("GROUP BY ALL", "GROUP BY src_port, k % 3, us")))
def pid_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = unified(spark, sf_dir).withColumn("proto", F.col("k") % 3).withColumnRenamed("pid", "real_pid")
    sockets = events.where("event_type = 'signup'").groupBy("src_port", "proto", F.col("us").alias("snapshot_us")).agg(F.max("real_pid").alias("pid"))
    return capture.owners(events.where("event_type <> 'signup'"), sockets, ["src_port", "proto"]).select("event_id", F.col("pid").alias("owner"))


@query(with_view("""SELECT directory, path, reason, event_id FROM (SELECT *, row_number() OVER (PARTITION BY directory, path ORDER BY us, event_id) AS rn FROM (
  SELECT directory, path, us, event_id, CASE WHEN event_type = 'error' AND path LIKE '%.exe' THEN 'rename_to_executable' WHEN pid <> creator AND contains(lower(process_name), 'powershell') THEN 'suspicious_process_cross_access'
    WHEN (us - born) // 1000000 > 86400 THEN 'long_lived_temp_file' WHEN directory IN ('dir1', 'dir2') AND path LIKE '%.txt' THEN 'document_in_high_churn_zone' END AS reason
  FROM (SELECT *, first_value(us) OVER w AS born, first_value(pid) OVER w AS creator FROM (SELECT *, concat('dir', k % 12) AS directory, concat('f', pid % 9, CASE k % 3 WHEN 0 THEN '.exe' WHEN 1 THEN '.txt' ELSE '.tmp' END) AS path FROM u) WINDOW w AS (PARTITION BY directory, path ORDER BY us, event_id))) WHERE reason IS NOT NULL) WHERE rn = 1"""))
def temp_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.concat(F.lit("f"), F.col("pid") % 9, F.when(k % 3 == 0, ".exe").when(k % 3 == 1, ".txt").otherwise(".tmp"))
    events = unified(spark, sf_dir).select("event_id", "us", "pid", "process_name", F.concat(F.lit("dir"), k % 12).alias("directory"), name.alias("path"), F.when(F.col("event_type") == "error", "rename").otherwise("write").alias("action"))
    busy = spark.createDataFrame([("dir1",), ("dir2",)], "directory string")
    return enrich.temp_anomalies(events, busy, 86400).select("directory", "path", "reason", "event_id")
