import random

from pyspark.sql import functions as F

from lodewatch import schemas
from lodewatch.operators import aggregates, components, correlate, stateful
from lodewatch.sources import readers, writers


def closure(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_window_edges_have_the_components_of_all_pairs(spark):
    random.seed(5)
    rows = [(i, random.randint(0, 300) * 500_000, random.choice(["a.exe", "B.exe", "svchost.exe", ""]), random.choice(["", "1", "2"])) for i in range(150)]
    events = spark.createDataFrame(rows, "event_id long, us long, process_name string, src_ip string")
    got = closure([r[0] for r in rows], [(r.a, r.b) for r in correlate.same_window(events, 3).collect()])
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] and a[2].lower() == b[2].lower() != "svchost.exe" and abs(a[1] - b[1]) <= 3_000_000 and (a[3] == b[3] or not (a[3] and b[3]))]
    assert got == closure([r[0] for r in rows], pairs)


def test_components_of_chains_and_none(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_anchored_windows(spark):
    seconds = [0, 60, 60.9, 61, 121.5, 122, 200]
    rows = [(i, "k", int(s * 1_000_000)) for i, s in enumerate(seconds)] + [(99, "k", None), (100, None, 5)]
    out = stateful.dedup_decisions(spark.createDataFrame(rows, "event_id long, key string, us long"), ["key"], 60)
    got = {r.event_id: (r.decision, r.nth) for r in out.collect()}
    assert got == {0: ("FORWARD", 1), 1: ("COMPRESS", 2), 2: ("COMPRESS", 3), 3: ("FORWARD", 1), 4: ("COMPRESS", 2), 5: ("FORWARD", 1), 6: ("FORWARD", 1), 99: ("FORWARD", 1), 100: ("FORWARD", 1)}


def test_writes_are_coalesced_until_close_delete_or_idle(spark):
    rows = [(1, "write", 0), (2, "write", 10), (3, "close", 11), (4, "write", 20), (5, "delete", 21), (6, "write", 30), (7, "write", 200)]
    events = spark.createDataFrame([(i, "f", a, s * 1_000_000) for i, a, s in rows], "event_id long, file_key string, action string, us long")
    got = sorted((r.first_us // 1_000_000, r.write_count, r.flushed_by) for r in aggregates.coalesced_writes(events).collect())
    assert got == [(0, 2, "close"), (30, 1, "stale"), (200, 1, "stale")]


def test_usb_anomalies(spark):
    mb = 1 << 20
    rows = [(1, "read", "a.txt", 300 * mb), (2, "read", "b", 203 * mb + 5), (3, "read", "b", 900 * mb), (4, "write", "x.EXE", 1), (5, "write", "x.EXE", 1), (6, "write", "p.ps1", 1)]
    events = spark.createDataFrame([("s", i, i, o, p, n) for i, o, p, n in rows], "session_key string, event_id long, us long, operation string, file_path string, size long")
    got = sorted((r.event_id, r.anomaly) for r in aggregates.usb_anomalies(events).collect())
    assert got == [(2, "high_read_volume: 503 MB read"), (4, "executable_written: x.EXE"), (6, "executable_written: p.ps1")]
    assert aggregates.usb_sessions(events).first().file_extensions == {".txt": 1, "(none)": 2, ".exe": 2, ".ps1": 1}


def test_readers_skip_what_is_torn(spark, tmp_path):
    (tmp_path / "net.jsonl").write_text('{"ts":"2026-01-05T10:00:01.000000Z","source":"npcap_live","pid":0,"src_ip":"10.0.0.5","dst_ip":"8.8.8.8","state":"CLOSED"}\n\n"pid":5,"x":1}\n{"pid": 7}\n')
    (tmp_path / "app.json").write_text('{\n "source": "PowerShell", "script_content": "if (x) { y }", "pattern_hits": 2, "timestamp": "2026-01-05 10:00:00"}\n{broken\n{"source": "WMI", "timestamp": "bad"}')
    net = readers.Normalizers().read(spark, str(tmp_path / "net.jsonl"), "network").orderBy("pid").collect()
    assert [(r.pid, r.record_type, r.tcp_state) for r in net] == [(0, "network_connect", "CLOSED"), (7, "network_connect", "")]
    both = readers.Normalizers().ingest(spark, {str(tmp_path / "net.jsonl"): "network", str(tmp_path / "app.json"): "applog"})
    assert both.schema.names == schemas.UNIFIED.names and both.count() == 4
    app = {r.source: r for r in both.where("source in ('PowerShell', 'WMI')").collect()}
    assert app["PowerShell"].script_content == "if (x) { y }" and app["WMI"].ts is None and app["WMI"].process_name == ""
    kinds = {r.source_file: r.format for r in readers.sniffed(spark, str(tmp_path)).collect()}
    assert kinds == {"net.jsonl": "network", "app.json": "applog"}


def test_sparse_lines(spark):
    df = spark.createDataFrame([(0, "", False, 5, "x")], "pid long, a string, f boolean, pattern_hits int, b string")
    assert df.select(writers.sparse(df)).first()[0] == '{"b":"x"}'


def test_group_dedup_sums(spark):
    rows = [(1, "t", ["p"], ["d"], ["x"], ["f"], 3), (2, "t", ["p"], ["d"], ["x"], ["f"], 9), (3, "u", ["p"], ["d"], ["x"], ["f"], 1)]
    groups = spark.createDataFrame(rows, "component long, corr_type string, processes array<string>, dest_ips array<string>, protocols array<string>, source_files array<string>, total_occurrences long")
    got = {(r.component, r.total_occurrences, r.repeat_count) for r in correlate.dedup_groups(groups).collect()}
    assert got == {(2, 12, 2), (3, 1, None)}


def test_stream_is_as_the_batch(spark, tmp_path):
    from lodewatch.streaming.stateful import anchored_stream

    random.seed(7)
    rows = sorted((random.randint(0, 600) * 1_000_000, i, random.choice("ab")) for i in range(60))
    events = spark.createDataFrame([(i, us, k) for us, i, k in rows], "event_id long, us long, k string").withColumn("ts", F.timestamp_micros("us"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = anchored_stream(stream, "k", 61_000_000).writeStream.format("memory").queryName("anchors").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.event_id, r.forwarded, r.nth) for r in spark.table("anchors").collect()}
    want = {(r.event_id, r.forwarded, r.nth) for r in stateful.anchored(events.drop("ts"), ["k"], 61_000_000).collect()}
    assert got == want
