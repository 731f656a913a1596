"""Queries for what endpoints compute: paths, times, packets, payloads, signatures, devices, temporary files, scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewatch.functions import classify, net, text
from lodewatch.functions import tables as T
from lodewatch.functions.decode import decoded
from lodewatch.operators import aggregates, capture, enrich, stateful, watchlist
from lodewatch.plans.queries import HOUR, _files, _usb
from lodewatch.plans.registry import ORACLE, query, with_view
from lodewatch.plans.views import table, unified
from lodewatch.shared import table_path, written
from lodewatch.sources import seen, writers


def _k() -> Column:
    return F.col("k")


def _utc(pattern: str) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_micros("us"), F.current_timezone()), pattern)


@query("SELECT page_id, 'c:\\b' || (page_id % 5) || '\\x.exe' AS path, 'c:\\p\\t' || page_id AS expanded, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'c:' END AS empty_path FROM pages")
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7"""
    i = F.col("page_id")
    path = F.concat(F.lit("C:/A/./../b"), i % 5, F.lit("\\q\\..\\X.exe"))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.canonical_path(path).alias("path"), enrich.canonical_variables(F.concat(F.lit("%ProgramFiles(x86)%\\t"), i), {"programfiles(X86)": "c:\\p"}).alias("expanded"),
        text.canonical_path(F.when(i % 3 == 0, "").otherwise("C:")).alias("empty_path"),
    )


@query("SELECT doc_id, rtrim(lower(nfc_normalize(substr(text, 1, 40))), ' ') || ' a' || chr(233) || ' x' AS command FROM documents WHERE NOT regexp_matches(substr(text, 1, 40), '\\s{2}|[\\t\\n\\r]')")
def command_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed characters."""
    docs = table(spark, sf_dir, "documents").where(~F.substring("text", 1, 40).rlike(r"\s{2}|[\t\n\r]"))
    return docs.select("doc_id", text.normalized_command(F.concat(F.substring("text", 1, 40), F.lit("  Ae\u0301 \t X"))).alias("command"))


@query(with_view("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN us WHEN 1 THEN us // 1000 * 1000 WHEN 2 THEN us // 1000000 * 1000000 WHEN 3 THEN us // 1000000 * 1000000 END AS us,
  strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.') || lpad((us // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS ms, us AS from_filetime, CASE WHEN event_id % 2 = 0 THEN us - 3600000000 END AS local_us FROM u"""))
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four forms and one that is no time; file times; local times in winter."""
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, _utc("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(i % 5 == 1, _utc("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(i % 5 == 2, _utc("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 5 == 3, _utc("yyyy-MM-dd HH:mm:ss")).otherwise("startup")
    local = F.when(i % 2 == 0, _utc("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return unified(spark, sf_dir).select(
        "event_id", F.unix_micros(text.parse_ts(raw)).alias("us"), text.iso_ms(F.timestamp_micros("us")).alias("ms"),
        F.unix_micros(text.filetime(F.col("us") * 10 + text.FILETIME_EPOCH)).alias("from_filetime"), F.unix_micros(text.parse_ts(local, "Europe/Berlin")).alias("local_us"),
    )


@query(with_view("""SELECT event_id, k % 3 <> 2 AND k % 5 <> 0 AS signature_valid, CASE WHEN k % 5 <> 0 THEN 'signer' || (k % 3) END AS signer, CASE k % 4 WHEN 0 THEN 'x:\\ntdll.dll' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'd:\\kernel32.dll' END AS shadowing, k % 6 < 2 AS new_child, false AS persistence_touched FROM u"""))
def process_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, modules and children of processes."""
    k = _k()
    signatures = unified(spark, sf_dir).select(F.concat(F.lit("p"), k).alias("canonical_path"), (k % 3 != 2).alias("valid"), F.concat(F.lit("signer"), k % 3).alias("signer"), F.lit("t").alias("thumbprint")).where(F.col("k") % 5 != 0).distinct()
    events = enrich.signed(unified(spark, sf_dir).withColumn("canonical_path", F.concat(F.lit("p"), k)), signatures)
    dlls = F.when(k % 4 == 0, F.array(F.lit("x:\\ntdll.dll"), F.lit("C:\\Sys\\ntdll.dll"))).when(k % 4 == 1, F.array(F.lit("c:\\sys\\kernel32.dll"))).when(k % 4 == 3, F.array(F.lit("d:\\kernel32.dll"), F.lit("d:\\other.dll")))
    children = F.when(k % 6 < 2, F.array(F.lit("e:\\odd.exe"))).otherwise(F.array(F.lit("c:\\sys\\ok.exe")))
    return events.select("event_id", "signature_valid", "signer", F.array_join(enrich.shadowing(dlls, ["NTDLL.dll", "kernel32.dll"], ["C:\\Sys\\"]), ",").alias("shadowing"), enrich.new_child(children, [("c:\\sys\\", "SYSTEM")]).alias("new_child"), enrich.persistence_touched().alias("persistence_touched"))


_HEX = {"HTTPS_TLS": "1603010005", "HTTP": "474554202F", "QUIC": "C3000000017A", "SSH": "5353482D322E", "SMTP": "45484C4F2061", "RDP": "0300001300", "SMB": "00000010FE534D42", "": "FFFFFFFF"}


@query(with_view("SELECT event_id, CASE k % 8 WHEN 0 THEN 'HTTPS_TLS' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'QUIC' WHEN 3 THEN 'SSH' WHEN 4 THEN 'SMTP' WHEN 5 THEN CASE WHEN dst_port = 3389 THEN 'RDP' END WHEN 6 THEN 'SMB' END AS layer, k % 3 = 0 AS loopback, k % 3 = 1 AS broadcast FROM u"))
def payload_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, P22"""
    k = _k()
    payload = F.unhex(F.element_at(F.array(*map(F.lit, _HEX.values())), (k % 8 + 1).cast("int")))
    ip = F.when(k % 3 == 0, F.when(k % 2 == 0, "127.0.0.9").otherwise("::1")).when(k % 3 == 1, "10.1.1.255").otherwise("10.255.1.1")
    return unified(spark, sf_dir).select("event_id", net.layer_by_payload(payload, F.col("dst_port"), F.col("src_port")).alias("layer"), net.is_loopback(ip).alias("loopback"), net.is_broadcast(ip).alias("broadcast"))


@query(with_view("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 6 ELSE 4 END AS version, CASE event_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 254 END AS protocol,
  CASE event_id % 4 WHEN 0 THEN '10.0.' || (k % 4) || '.5' WHEN 1 THEN 'fe80::' || printf('%x', k % 4 + 10) WHEN 2 THEN '10.0.0.1' END AS src_ip,
  CASE event_id % 4 WHEN 0 THEN '8.8.8.' || (pid % 250) WHEN 1 THEN '::1:0:0:2' WHEN 2 THEN '10.0.0.2' END AS dst_ip,
  CASE WHEN event_id % 4 = 2 THEN 0 ELSE src_port END::INT AS src_port, CASE WHEN event_id % 4 = 2 THEN 0 ELSE dst_port END AS dst_port, CASE WHEN event_id % 4 = 0 THEN 18 ELSE 0 END AS flags, CASE event_id % 4 WHEN 0 THEN '474554202F' WHEN 1 THEN '71' ELSE '' END AS payload FROM u WHERE event_id % 4 <> 3"""))
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames built from the view's rows: TCP under a VLAN tag, UDP over IPv6, ARP, and one cut short."""
    i, k = F.col("event_id"), _k()
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    two = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    ports = F.concat(two(F.col("src_port")), two(F.col("dst_port")))
    tcp = F.concat(F.lit("00" * 12 + "8100" + "0001" + "0800" + "45" + "00" * 8 + "06" + "0000" + "0A00"), byte(k % 4), F.lit("05" + "080808"), byte(F.col("pid") % 250), ports, F.lit("00" * 8 + "50" + "12" + "00" * 6 + "474554202F"))
    udp = F.concat(F.lit("00" * 12 + "86DD" + "60" + "00" * 5 + "11" + "40" + "FE80" + "00" * 13), byte(k % 4 + 10), F.lit("0000" * 4 + "0001" + "0000" * 2 + "0002"), ports, F.lit("00000000" + "71"))
    arp = F.lit("00" * 12 + "0806" + "00" * 14 + "0A000001" + "00" * 6 + "0A000002")
    frame = F.unhex(F.when(i % 4 == 0, tcp).when(i % 4 == 1, udp).when(i % 4 == 2, arp).otherwise("0800"))
    frames = written(unified(spark, sf_dir).select("event_id", frame.alias("frame")), "frames")
    return capture.parsed_packets(frames).withColumn("payload", F.hex("payload"))


@query(with_view("SELECT event_id, '{' || concat_ws(',', '\"event_id\":' || event_id, CASE WHEN pid <> 0 THEN '\"pid\":' || pid END, CASE WHEN src_ip <> '' THEN '\"src_ip\":\"' || src_ip || '\"' END, CASE WHEN k % 2 = 0 THEN '\"flag\":true' END) || '}' AS line FROM u"))
def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, P27"""
    rows = unified(spark, sf_dir).select("event_id", "pid", "src_ip", (_k() % 2 == 0).alias("flag"), F.lit(7).alias("pattern_hits"))
    return rows.select("event_id", writers.sparse(rows).alias("line"))


@query(with_view("SELECT event_id, lpad((1000 + k % 50)::VARCHAR, 4, '0') AS vid, lpad((2000 + k % 7)::VARCHAR, 4, '0') AS pid, CASE WHEN k % 3 = 0 THEN 'SER' || (1000 + k) ELSE '' END AS serial, CASE WHEN k % 3 = 0 THEN 'SER' || (1000 + k) ELSE (1000 + k % 50) || ':' || (2000 + k % 7) || ':sfx' END AS session_key FROM u"))
def usb_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29, P30, F13"""
    k = _k()
    tail = F.when(k % 3 == 0, F.concat(F.lit("SER"), 1000 + k)).when(k % 3 == 1, "6&abc&0").otherwise("abc")
    instance = F.concat(F.lit("USB\\VID_"), 1000 + k % 50, F.lit("&PID_"), 2000 + k % 7, F.lit("\\"), tail)
    devices = unified(spark, sf_dir).select("event_id", instance.alias("instance"), F.lit("DiskDrive").alias("class"))
    other = devices.withColumn("class", F.lit("HIDClass"))
    vid, pid, serial = text.usb_ids(F.col("instance"))
    found = capture.storage_devices(devices.unionByName(other)).select("event_id", vid.alias("vid"), pid.alias("pid"), serial.alias("serial"))
    return found.withColumn("session_key", text.session_key(F.col("vid"), F.col("pid"), F.col("serial"), F.lit("sfx")))


@query(with_view("""SELECT event_id, CASE k % 5 WHEN 0 THEN 'PowerShell' WHEN 1 THEN 'WMI' WHEN 2 THEN 'Security' WHEN 3 THEN 'WindowsDefender' ELSE 'tool' END AS source,
  CASE k % 5 WHEN 0 THEN '4104' WHEN 1 THEN '5861' WHEN 2 THEN '4625' WHEN 3 THEN '1116' ELSE '' END AS event_code,
  CASE k % 5 WHEN 0 THEN 'Script: iex "ab' || k || '" AmsiUtils http://h.x/' || k WHEN 1 THEN 'WMI persistence binding — Consumer: c' || k || ' | Filter: f' WHEN 2 THEN 'FAILED LOGON — Account: ' || user_name || ' | Type: 3 | From: ' || dst_ip
    WHEN 3 THEN 'Defender: [T' || k || '] at c:\\x | Action: Q' ELSE 'Event from tool | ID: ' END AS summary,
  CASE WHEN k % 5 = 0 THEN 'http://h.x/' || k ELSE '' END AS network_activity, k % 5 = 0 AS amsi_bypass, k % 5 = 1 AS process_injection, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS pattern_hits, CASE WHEN k % 5 = 0 THEN 'c:\\s' || k || '.ps1' ELSE '' END AS script_path,
  CASE k % 5 WHEN 2 THEN 'Account: ' || user_name || chr(10) || 'LogonType: 3' || chr(10) || 'SourceIP: ' || dst_ip || chr(10) WHEN 4 THEN 'plain ' || k ELSE '' END AS content FROM u"""))
def decoded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoders of each source of application logs."""
    k = _k()
    data = lambda **kv: F.concat(*(F.concat(F.lit(f"<Data Name='{n.replace('_', ' ')}'>"), F.lit(v) if isinstance(v, str) else v, F.lit("</Data>")) for n, v in kv.items()))
    shell = data(ScriptBlockText=F.concat(F.lit('ie`x "a" + "b'), k, F.lit('" AmsiUtils http://h.x/'), k), Path=F.concat(F.lit("c:\\s"), k, F.lit(".ps1")))
    wmi = F.concat(F.lit("<EventID>5861</EventID>"), data(CONSUMER=F.concat(F.lit("c"), k), FILTER="f", Query="Win32_Process Create"))
    security = F.concat(F.lit("<EventID>4625</EventID>"), data(TargetUserName=F.col("user_name"), LogonType="3", IpAddress=F.col("dst_ip")))
    defender = data(Threat_Name=F.concat(F.lit("T"), k), Path="c:\\x", Action="Q")
    source = F.when(k % 5 == 0, "PowerShell").when(k % 5 == 1, "WMI").when(k % 5 == 2, "Security").when(k % 5 == 3, "WindowsDefender").otherwise("tool")
    raw = F.when(k % 5 == 0, shell).when(k % 5 == 1, wmi).when(k % 5 == 2, security).when(k % 5 == 3, defender).otherwise(F.concat(F.lit("plain "), k))
    out = decoded(unified(spark, sf_dir).select("event_id", source.alias("source"), raw.alias("raw")))
    return out.select("event_id", "source", "event_code", "summary", "network_activity", "amsi_bypass", "process_injection", "pattern_hits", "script_path", F.when(F.col("source").isin("Security", "tool"), F.col("script_content")).otherwise("").alias("content"))


@query(with_view("SELECT event_id, contains(lower(process_name), 'powershell') AND k % 7 IN (0, 4) OR lower(process_name) IN ('proc5.exe', 'proc7.exe') OR (NOT contains(lower(process_name), 'powershell') AND k % 3 = 1 AND k % 7 IN (1, 2)) AS watched, k % 6 < 4 AS subscribed, k % 2 = 0 AND NOT (k % 5 = 0 AND k % 3 = 0) AS of_provider FROM u"))
def watched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, S16, F11, F14, U2"""
    k = _k()
    listed = watchlist.removed(watchlist.added(watchlist.watchlist(spark, ["Proc5.exe", "gone.exe"]), "proc7.EXE "), "gone.exe")
    source = F.when(F.lower("process_name").contains("powershell"), "PowerShell").when(k % 3 == 1, "WMI").otherwise("tool")
    code = F.when(k % 7 == 1, 5859).when(k % 7 == 2, 5861).when(k % 7 == 0, 4104).when(k % 7 == 4, 4104).otherwise(1)
    b = unified(spark, sf_dir)
    mark = lambda df, name: df.select("event_id").withColumn(name, F.lit(True))
    seen_ = capture.watched(b.withColumns({"source": source, "code": code}), listed)
    kept = capture.subscribed(b.withColumn("code", F.element_at(F.array(*map(F.lit, (4625, 4672, 1116, 1118, 1, 2))), (k % 6 + 1).cast("int"))))
    own = capture.of_provider(b.withColumns({"provider": F.when(k % 2 == 0, "{AB-1}").otherwise("{CD-2}"), "opcode": k % 5, "code": k % 3}), "{ab-1}")
    out = b.select("event_id")
    for name, df in (("watched", seen_), ("subscribed", kept), ("of_provider", own)):
        out = out.join(mark(df, name), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query(with_view("SELECT 'powershell.exe' AS app_name, count(DISTINCT pid) AS n, true AS active FROM u WHERE lower(process_name) = 'powershell.exe' UNION ALL SELECT 'none.exe', 0, false"))
def watchlist_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2"""
    found = watchlist.running(watchlist.watchlist(spark, ["PowerShell.exe", "none.exe", "POWERSHELL.EXE"]), unified(spark, sf_dir))
    return found.select("app_name", F.size("pids").cast("long").alias("n"), "active")


_LANG = (("powershell.exe", "POWERSHELL"), ("wscript.exe", "WSCRIPT"), ("C:\\x\\Python3.exe", "PYTHON"), ("other", "UNKNOWN"), ("cmd.exe", "BATCH"))


@query(with_view("SELECT event_id, l AS language, CASE WHEN k % 4 = 0 AND l = 'POWERSHELL' THEN 4 WHEN k % 4 = 0 THEN 3 WHEN k % 4 = 1 AND (user_name LIKE 'user1%') THEN 4 WHEN k % 4 = 1 THEN 2 WHEN k % 4 = 2 THEN 5 ELSE 1 END AS severity FROM (SELECT *, CASE k % 5 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(_LANG)) + " END AS l FROM u)"))
def script_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflective loading in the shell, supply chain as an administrator, ransomware."""
    k = _k()
    app = F.element_at(F.array(*(F.lit(a) for a, _ in _LANG)), (k % 5 + 1).cast("int"))
    script = F.when(k % 4 == 0, "x LoadLibraryA y").when(k % 4 == 1, "run setup.py").when(k % 4 == 2, "aes.Create()").otherwise("plain")
    user = F.when(F.col("user_name").like("user1%"), F.when(k % 3 == 0, "SYSTEM").otherwise("LAB\\ADMINISTRATOR")).otherwise("bob")
    language = classify.script_language(app)
    return unified(spark, sf_dir).select("event_id", language.alias("language"), classify.script_severity(classify.script_match(script), language, user).alias("severity"))


@query(with_view("SELECT event_id, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 2 ELSE 0 END AS severity, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 2 ELSE 2 END AS fresh FROM u"))
def rename_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move into a protected folder; within one it is rated as it is."""
    k = _k()
    path = F.when(k % 3 == 0, "d:\\data\\x.dat").otherwise("c:\\win\\x.dat")
    moved = F.when(k % 3 == 2, "c:\\win\\y.dat").otherwise("d:\\y.dat")
    rated = lambda old: classify.file_severity(F.lit("rename"), path, F.lit("tool.exe"), (), ("C:\\Win",), old)
    base = rated(None)
    # In a protected folder a rename is WARNING by the rules alone; the bump shows where they say less.
    return unified(spark, sf_dir).select("event_id", F.when(k % 3 == 2, rated(moved) - base).otherwise(rated(moved)).cast("int").alias("severity"), rated(F.lit("")).alias("fresh"))


_NETS = (("0.0.0.0", 24), ("10.0.0.0", 24), ("127.0.0.0", 24), ("169.254.0.0", 16), ("172.16.0.0", 20), ("192.0.0.0", 8), ("192.0.2.0", 8), ("192.168.0.0", 16), ("198.18.0.0", 17), ("198.51.100.0", 8), ("203.0.113.0", 8), ("224.0.0.0", 28), ("240.0.0.0", 28))


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


_SPREAD = "(i % 13 + 1)"
_BASES = "[" + ", ".join(f"{_number(ip)}" for ip, _ in _NETS) + "]"
_SIZES = "[" + ", ".join(f"{1 << bits}" for _, bits in _NETS) + "]"


@query(f"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN b WHEN 1 THEN b + s - 1 WHEN 2 THEN b + s ELSE greatest(b - 1, 0) END % 4294967296 AS n FROM (SELECT event_id, ({_BASES})[event_id // 4 % 13 + 1] AS b, ({_SIZES})[event_id // 4 % 13 + 1] AS s FROM events))
SELECT event_id, (n >> 24) || '.' || (n >> 16 & 255) || '.' || (n >> 8 & 255) || '.' || (n & 255) AS ip, NOT ({" OR ".join(f"n BETWEEN {_number(ip)} AND {_number(ip) + (1 << bits) - 1}" for ip, bits in _NETS)}) AS is_public FROM x""")
def public_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, dotted addresses: both ends of every network that is not public, and the addresses beside them."""
    at = (F.floor(F.col("event_id") / 4) % 13 + 1).cast("int")
    base, size = (F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), at) for xs in ([_number(ip) for ip, _ in _NETS], [1 << bits for _, bits in _NETS]))
    i = F.col("event_id") % 4
    n = F.when(i == 0, base).when(i == 1, base + size - 1).when(i == 2, base + size).otherwise(F.greatest(base - 1, F.lit(0))) % (1 << 32)
    return table(spark, sf_dir, "events").select("event_id", net.dotted(n).alias("ip"), net.is_public_ipv4(net.dotted(n)).alias("is_public"))


@query(with_view(f"""SELECT event_id, CASE WHEN k % 3 = 2 AND c.directory IS NOT NULL THEN 'B' WHEN k % 3 = 2 THEN 'C' ELSE 'A' END AS route FROM (SELECT *, concat('dir', k % 12) AS directory, us // {HOUR}000000 * {HOUR}000000 AS w FROM u) x
LEFT JOIN (SELECT DISTINCT directory, w + h * {HOUR}000000 AS w FROM (SELECT directory, w FROM (SELECT concat('dir', k % 12) AS directory, us // {HOUR}000000 * {HOUR}000000 AS w FROM u) GROUP BY ALL HAVING count(*) >= 2), range(5) AS r(h)) c USING (directory, w)"""))
def churn_reroute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders stay busy for five windows."""
    k = _k()
    events = unified(spark, sf_dir).select("event_id", "us", F.concat(F.lit("dir"), k % 12).alias("directory"), F.when(k % 3 == 2, "C").otherwise("A").alias("route"))
    busy = aggregates.churning(events, "directory", HOUR, 2, 5 * HOUR)
    return enrich.rerouted(events, busy, HOUR * 1_000_000).select("event_id", "route")


_TEMP = """fl AS (SELECT event_id, us, concat('dir', k % 6) AS directory, pid % 10 AS pid, concat('f', k % 3) AS path, event_type = 'error' AS elevated, CASE WHEN event_type IN ('purchase', 'click') THEN 'delete' ELSE 'write' END AS action FROM u),
s1 AS (SELECT *, sum(far) OVER (PARTITION BY directory, pid ORDER BY us, event_id) AS session FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY directory, pid ORDER BY us, event_id) > 360000000000 THEN 1 ELSE 0 END AS far FROM fl)),
s2 AS (SELECT *, CASE WHEN coalesce(lag(action) OVER (PARTITION BY directory, pid, session, path ORDER BY us, event_id), 'delete') = 'delete' THEN 1 ELSE 0 END AS born FROM s1),
s3 AS (SELECT *, sum(born) OVER (PARTITION BY directory, pid, session, path ORDER BY us, event_id) AS life, sum(born - CASE WHEN action = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY directory, pid, session ORDER BY us, event_id) AS alive FROM s2),
s4 AS (SELECT *, coalesce(sum(CASE WHEN alive = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY directory, pid, session ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bucket FROM s3),
s5 AS (SELECT directory, pid, session, bucket, path, life, max(born) AS born, max(CASE WHEN action = 'delete' THEN 1 ELSE 0 END) AS gone, max(elevated::INT) AS up, min(us) AS lo, max(us) AS hi FROM s4 GROUP BY ALL)"""


@query(with_view("SELECT directory, pid, session::BIGINT AS session, bucket::BIGINT AS bucket, sum(born)::BIGINT AS total_created, sum(gone)::BIGINT AS total_deleted, sum(up)::BIGINT AS elevated_count, min(lo) AS first_us, max(hi) AS last_us FROM s5 GROUP BY ALL", _TEMP))
def temp_bucket_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that end when none of their files is alive."""
    k = _k()
    action = F.when(F.col("event_type").isin("purchase", "click"), "delete").otherwise("write")
    events = unified(spark, sf_dir).select("event_id", "us", F.concat(F.lit("dir"), k % 6).alias("directory"), (F.col("pid") % 10).alias("pid"), F.concat(F.lit("f"), k % 3).alias("path"), (F.col("event_type") == "error").alias("elevated"), action.alias("action"))
    return aggregates.temp_buckets(events, idle_s=360000, path="path")


@query(with_view("""SELECT event_id, CASE WHEN (us, event_id) >= (up_us, up_id) THEN 'ELEVATED' WHEN action = 'delete' THEN 'DROPPED' ELSE 'WATCHING' END AS state FROM (
  SELECT *, first_value(CASE WHEN bad THEN us END IGNORE NULLS) OVER w AS up_us, first_value(CASE WHEN bad THEN event_id END IGNORE NULLS) OVER w AS up_id FROM (
    SELECT *, (pid <> first_value(pid) OVER o AND contains(lower(process_name), 'powershell')) OR (us - first_value(us) OVER o) // 1000000 > 864000 AS bad FROM t WINDOW o AS (PARTITION BY path ORDER BY us, event_id))
  WINDOW w AS (PARTITION BY path ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
  "t AS (SELECT event_id, us, pid, process_name, concat('f', pid % 3, '-', k, '.tmp') AS path, CASE WHEN event_type IN ('purchase', 'click') THEN 'delete' ELSE 'write' END AS action FROM u)"))
def temp_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7"""
    return enrich.temp_states(_temp_files(spark, sf_dir), spark.createDataFrame([], "directory string"), 864000).select("event_id", "state")


def _temp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type").isin("purchase", "click"), "delete").otherwise("write")
    return unified(spark, sf_dir).select("event_id", "us", "pid", "process_name", F.lit("d").alias("directory"), F.concat(F.lit("f"), F.col("pid") % 3, F.lit("-"), "k", F.lit(".tmp")).alias("path"), action.alias("action"))


@query(with_view("""SELECT s.event_id, p.path AS parent_path, p.us AS parent_start_us FROM s ASOF LEFT JOIN (SELECT pid, us, max(path) AS path FROM s GROUP BY pid, us) p ON s.parent_pid = p.pid AND s.us >= p.us""",
  "s AS (SELECT event_id, us, pid % 50 AS pid, (pid + k) % 50 AS parent_pid, concat('c:/', process_name) AS path FROM u WHERE event_type IN ('signup', 'view'))"))
def parent_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9"""
    events = unified(spark, sf_dir).select("event_id", "us", (F.col("pid") % 50).alias("pid"), ((F.col("pid") + _k()) % 50).alias("parent_pid"), F.concat(F.lit("c:/"), "process_name").alias("path"), F.when(F.col("event_type").isin("signup", "view"), "start").otherwise("other").alias("kind"))
    return aggregates.parents(events).select("event_id", "parent_path", "parent_start_us")


@query(with_view("""SELECT event_id, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER w::BIGINT AS child_count, sum(CASE WHEN kind = 'thread' THEN 1 ELSE 0 END) OVER w::BIGINT AS thread_count, kind = 'start' AND k % 2 = 0 AS new_child FROM (
  SELECT *, sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' WHEN 'view' THEN 'thread' ELSE 'other' END AS kind FROM u))
WINDOW w AS (PARTITION BY pid, life ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""".replace("ELSE 0 END) OVER w::BIGINT", "ELSE 0 END) OVER w")))
def child_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12"""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").when(F.col("event_type") == "view", "thread").otherwise("other")
    events = unified(spark, sf_dir).select("event_id", "us", kind.alias("kind"), F.col("pid").alias("parent_pid"), F.col("process_name").alias("child_name"), (_k() % 2 == 0).alias("odd"))
    return aggregates.child_counts(events).select("event_id", "child_count", "thread_count", "new_child")


@query(with_view("""SELECT session_key, round((max(us) - min(us)) / 1000000.0, 3) AS duration_seconds, round((max(us) - coalesce(max(us) FILTER (WHERE operation NOT IN ('removal')), min(us))) / 1000000.0, 3) AS idle_seconds, any_value(a.n) AS anomalies
FROM (SELECT session_key, us, CASE WHEN k % 10 = 0 AND event_type = 'error' THEN 'removal' ELSE 'io' END AS operation FROM (SELECT *, concat('dev', pid % 25) AS session_key FROM u)) x
JOIN (SELECT session_key, count(DISTINCT CASE WHEN event_type = 'click' AND k % 5 IN (0, 1) THEN k END)::INT AS n FROM (SELECT *, concat('dev', pid % 25) AS session_key FROM u) GROUP BY session_key) a USING (session_key) GROUP BY session_key"""))
def usb_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, idle time and anomalies of sessions; sizes are small, so that only executables are anomalies."""
    events = _usb(spark, sf_dir).join(unified(spark, sf_dir).select("event_id", "k", "event_type"), "event_id")
    removal = (_k() % 10 == 0) & (F.col("event_type") == "error")
    few = events.where("event_type <> 'purchase'").unionByName(events.where("event_type = 'purchase'").withColumn("operation", F.lit("read"))).withColumn("size", F.lit(1))
    out = aggregates.usb_reports(few.withColumn("operation", F.when(removal, "removal").otherwise(F.col("operation"))).drop("k", "event_type"))
    return out.select("session_key", "duration_seconds", "idle_seconds", F.size("anomalies").alias("anomalies"))


@query(with_view("SELECT event_id, coalesce('h' || (CASE WHEN k % 5 <> 0 THEN k % 7 END), dst_ip) AS hostname FROM (SELECT event_id, k, CASE WHEN k % 5 = 0 THEN '10.9.9.' || (k % 7) ELSE '10.9.8.' || (k % 7) END AS dst_ip FROM u)"))
def hostnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24"""
    k = _k()
    events = unified(spark, sf_dir).select("event_id", F.when(k % 5 == 0, F.concat(F.lit("10.9.9."), k % 7)).otherwise(F.concat(F.lit("10.9.8."), k % 7)).alias("dst_ip"))
    names = spark.range(7).select(F.concat(F.lit("10.9.8."), "id").alias("ip"), F.concat(F.lit("h"), "id").alias("hostname"))
    return capture.with_hostnames(events, names).select("event_id", "hostname")


@query(with_view("""SELECT event_id, sha256(path) AS process_key, sha256(sha256(parent) || sha256(path)) AS relation_key, event_id >= (SELECT max(event_id) // 2 FROM u) AND row_number() OVER (PARTITION BY path ORDER BY us, event_id) = 1 AND path NOT IN (SELECT path FROM x WHERE event_id < (SELECT max(event_id) // 2 FROM u)) AS novel FROM x""",
  "x AS (SELECT event_id, us, concat('c:/', process_name, pid % 40) AS path, concat('c:/', k % 9) AS parent FROM u)"))
def kept_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the events is seen and kept; what is novel in all events after that."""
    events = unified(spark, sf_dir).select("event_id", "us", F.concat(F.lit("c:/"), "process_name", F.col("pid") % 40).alias("path"), F.concat(F.lit("c:/"), _k() % 9).alias("parent"))
    process, relation = text.novelty_keys(F.col("path"), F.col("parent"))
    events = events.withColumns({"process_key": process, "relation_key": relation})
    half = events.agg(F.call_function("div", F.max("event_id"), F.lit(2))).first()[0]
    path = table_path(spark, "seen")
    early = events.where(F.col("event_id") < half)
    seen.keep(stateful.unseen(early, ["process_key"], seen.load(spark, path, ["process_key"])), path, ["process_key"])
    return stateful.unseen(events, ["process_key"], seen.load(spark, path, ["process_key"])).select("event_id", "process_key", "relation_key", "novel")


@query(ORACLE["kept_novelty"])
def filtered_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same behind a filter of bits, so that only parts of what is kept are read."""
    events = unified(spark, sf_dir).select("event_id", "us", F.concat(F.lit("c:/"), "process_name", F.col("pid") % 40).alias("path"), F.concat(F.lit("c:/"), _k() % 9).alias("parent"))
    process, relation = text.novelty_keys(F.col("path"), F.col("parent"))
    events = events.withColumns({"process_key": process, "relation_key": relation})
    half = events.agg(F.call_function("div", F.max("event_id"), F.lit(2))).first()[0]
    kept = seen.Filtered(spark, table_path(spark, "filtered"), ("process_key",))
    early = events.where(F.col("event_id") < half)
    kept.keep(stateful.unseen(early, ["process_key"], kept.seen(early)))
    return stateful.unseen(events, ["process_key"], kept.seen(events)).select("event_id", "process_key", "relation_key", "novel")


@query(with_view("SELECT count(*) FILTER (WHERE k % 4 <> 3) AS packets_validated, count(*) AS packets_received, count(*) FILTER (WHERE k % 4 = 3) AS packets_dropped, count(*) FILTER (WHERE k % 5 <> 0) AS events_generated, count(*) FILTER (WHERE k % 5 = 0) AS noise_suppressed, (SELECT count(DISTINCT (src_ip, dst_ip)) FROM u) AS flows_created, (SELECT count(*) FROM (SELECT 1 FROM u GROUP BY src_ip, dst_ip HAVING bool_or(tcp_state = 'CLOSED'))) AS flows_expired FROM u"))
def packet_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    b, k = unified(spark, sf_dir), _k()
    flows = b.groupBy("src_ip", "dst_ip").agg(F.bool_or(F.col("tcp_state") == "CLOSED").alias("closed"))
    return capture.packet_counters(b.select((k % 4 != 3).alias("parsed")), b.select((k % 5 == 0).alias("is_noise")), flows)


@query("SELECT count(*) AS captured, count(*) FILTER (WHERE logged) AS logged, count(*) FILTER (WHERE logged AND rn > 1) AS dedup, count(*) FILTER (WHERE NOT logged) AS filtered FROM (SELECT doc_id % 3 <> 0 AS logged, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)")
def script_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21"""
    docs = stateful.first_seen(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"])
    return capture.script_counters(docs.select((F.col("doc_id") % 3 != 0).alias("logged"), (~F.col("novel")).alias("is_dedup")))


@query("SELECT doc_id, '{\"ts\":\"t\",\"type\":\"' || CASE WHEN doc_id % 2 = 0 THEN 'FULL' ELSE 'DEDUP' END || '\",\"endpoint\":\"amsi_monitor\",' || CASE WHEN doc_id % 2 = 0 THEN '\"source\":\"AMSI-Buffer\",' ELSE '' END || '\"severity\":\"LOW\",\"lang\":\"BATCH\",\"detection\":\"NONE\",\"hash\":\"' || md5(doc_id::VARCHAR) || '\",' || CASE WHEN doc_id % 2 = 0 THEN '\"details\":{\"app_name\":\"a\",\"content_name\":\"c\",\"encoded_content\":\"' || base64(encode(doc_id::VARCHAR)) || '\"},' ELSE '' END || '\"actor\":{\"pid\":' || doc_id || ',\"user\":\"u\"}}' AS line FROM documents")
def script_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5"""
    docs = table(spark, sf_dir, "documents").select(F.lit("t").alias("ts"), F.lit("LOW").alias("severity"), F.lit("BATCH").alias("lang"), F.lit("NONE").alias("detection"), F.md5(F.col("doc_id").cast("string")).alias("hash"), F.lit("a").alias("app_name"), F.lit("c").alias("content_name"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("content"), F.col("doc_id").alias("pid"), F.lit("u").alias("user"), (F.col("doc_id") % 2 == 1).alias("is_dedup"))
    out = writers.script_log(docs)
    return out.select(F.col("actor.pid").alias("doc_id"), F.to_json(F.struct(*out.columns)).alias("line"))


@query(with_view("SELECT event_id, CASE k % 4 + 1 WHEN 1 THEN 'process_start' WHEN 2 THEN 'process_stop' WHEN 3 THEN 'process_snapshot' END AS kind FROM u"))
def process_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7"""
    return unified(spark, sf_dir).select("event_id", capture.process_kind(_k() % 4 + 1).alias("kind"))


@query("SELECT doc_id, 'hello there ' || doc_id AS decoded_command, doc_id || '.5' AS data, 'v' || doc_id AS field, CASE WHEN doc_id % 3 = 0 THEN 'SPAN' ELSE '' END AS other FROM documents")
def script_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded commands in two-byte characters, XML fields."""
    i = F.col("doc_id")
    encoded = F.base64(F.encode(F.concat(F.lit("hello there "), i), "UTF-16LE"))
    raw = F.concat(F.lit("<A x='1'>v"), i, F.lit("</A><Data Name=\"D\">"), i, F.lit(".5</Data>"), F.when(i % 3 == 0, "<Other>SPAN</Other>").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.encoded_command(F.concat(F.lit("p.exe -EncodedCommand "), encoded)).alias("decoded_command"), text.xml_data(raw, "D").alias("data"), text.xml_field(raw, "A").alias("field"), text.xml_field(raw, "Other").alias("other"))


@query(with_view("SELECT event_id, severity FROM (SELECT event_id, CASE k % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'ALERT' WHEN 2 THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM u)"))
def severity_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: rows with the severity first, written as lines and read back."""
    path = table_path(spark, "severity")
    labelled = writers.with_severity(unified(spark, sf_dir).select("event_id", "k"), classify.label(_k() % 4, T.FILE_SEVERITIES)).drop("k")
    writers.write_lines(labelled, path, per_file=500, mode="overwrite")
    lines = spark.read.text(path).where(F.col("value").startswith('{"severity":'))
    return lines.select(F.from_json("value", "event_id long, severity string").alias("r")).select("r.*")


@query(with_view("SELECT directory, action, count(*) AS n FROM (SELECT concat('dir', k % 12) AS directory, CASE event_type WHEN 'purchase' THEN 'close' WHEN 'signup' THEN 'delete' ELSE 'write' END AS action FROM u) GROUP BY CUBE (directory, action)"))
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "close", "delete", "write").cube("directory", "action").agg(F.count("*").alias("n"))


@query(with_view("SELECT pid, quantile_disc(bytes, 0.5) AS median, quantile_disc(bytes, 0.95) AS p95, count(DISTINCT dst_ip) AS n_ips, true AS near FROM u GROUP BY pid"))
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles; the approximate number of distinct addresses is within a tenth, or one, of the exact one."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY bytes)").cast("long")
    out = unified(spark, sf_dir).groupBy("pid").agg(disc(0.5).alias("median"), disc(0.95).alias("p95"), F.count_distinct("dst_ip").alias("n_ips"), F.approx_count_distinct("dst_ip", 0.02).alias("about"))
    return out.select("pid", "median", "p95", "n_ips", (F.abs(F.col("about") - F.col("n_ips")) <= F.greatest(F.lit(1), F.col("n_ips") / 10)).alias("near"))


@query(with_view("SELECT pid, 'both' AS side FROM (SELECT pid FROM u WHERE event_type = 'signup' INTERSECT SELECT pid FROM u WHERE event_type = 'purchase') UNION ALL SELECT pid, 'one' FROM (SELECT pid FROM u WHERE event_type = 'signup' EXCEPT SELECT pid FROM u WHERE event_type = 'purchase')"))
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: unified(spark, sf_dir).where(F.col("event_type") == t).select("pid")
    both, one = of("signup").intersect(of("purchase")), of("signup").subtract(of("purchase"))
    return both.withColumn("side", F.lit("both")).unionByName(one.withColumn("side", F.lit("one")))


@query(with_view(f"SELECT directory, (us // {HOUR}000000 - s) * {HOUR}000000 AS start_us, count(*) AS n FROM (SELECT us, concat('dir', k % 12) AS directory FROM u), range(2) AS r(s) GROUP BY ALL"))
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each folder in windows of two hours, an hour apart."""
    events = unified(spark, sf_dir).select(F.timestamp_micros("us").alias("ts"), F.concat(F.lit("dir"), _k() % 12).alias("directory"))
    return events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "directory").agg(F.count("*").alias("n")).select("directory", F.unix_micros("w.start").alias("start_us"), "n")


@query(with_view("SELECT event_id, us, row_number() OVER (ORDER BY us, event_id) AS place FROM u ORDER BY us, event_id LIMIT 100"))
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the first hundred in the order of time."""
    from lodewatch.operators.correlate import in_order

    first = in_order(unified(spark, sf_dir)).limit(100)
    return first.select("event_id", "us", F.row_number().over(Window.orderBy("us", "event_id")).cast("long").alias("place"))
