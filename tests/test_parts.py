"""Documents and rotated logs as files, counters seen on the way, models saved and loaded, strict logs, functions as sources."""

import gzip
import json
from pathlib import Path

from pyspark.sql import functions as F

from lodewatch import api, shared
from lodewatch.operators import components, correlate, observed, risk, scan, stateful, threat
from lodewatch.plans import files
from lodewatch.sources import readers, seen, writers


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_a_document_is_one_value(spark, tmp_path):
    lines = [{"ts": f"2026-01-05T10:{i // 60:02d}:{i % 60:02d}Z", "source": "npcap_live", "pid": i % 5, "process_name": f"p{i % 7}.exe", "src_ip": "10.0.0.1", "dst_ip": f"8.8.8.{i % 9}", "src_port": i % 3, "dst_port": 80, "direction": ["INBOUND", "OUTBOUND"][i % 2]} for i in range(120)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    found = api.correlate_files(spark, [str(tmp_path / "in.jsonl")], window=5)
    found.write_document(str(tmp_path / "out"))
    made = json.loads(text_of(tmp_path / "out"))
    assert made["meta"]["total_events"] == 120 and made["meta"]["total_groups"] == found.groups.count()
    assert {g["corr_id"] for g in made["correlated_groups"]} == {r.corr_id for r in found.groups.collect()}
    found.groups.limit(0).write.parquet(str(tmp_path / "none"))
    writers.write_document(spark.read.schema(found.groups.schema).parquet(str(tmp_path / "none")), str(tmp_path / "empty"), writers.meta(found.events, found.groups))
    assert json.loads(text_of(tmp_path / "empty"))["correlated_groups"] == []


def test_correlation_keeps_only_its_events(spark, tmp_path, monkeypatch):
    lines = [{"ts": f"2026-01-05T10:{i // 60 % 60:02d}:{i % 60:02d}Z", "source": "npcap_live", "record_type": "process_start" if i % 9 == 0 else "script_execution" if i % 9 == 1 else "network_connect", "pid": i % 40, "process_name": f"p{i % 7}.exe" if i % 9 else "powershell.exe", "src_ip": f"10.0.0.{i % 3}", "dst_ip": f"8.8.8.{i % 9}", "src_port": i % 3, "dst_port": 80, "direction": ["INBOUND", "OUTBOUND"][i % 2]} for i in range(0, 3000, 7)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines + lines[:5])))
    tables, kinds = Path(shared.session_dir(spark).removeprefix("file://")), []
    before = set(tables.iterdir()) if tables.exists() else set()
    monkeypatch.setattr(correlate, "components", lambda links: kinds.append(links.schema["a"].dataType.simpleString()) or components.components(links, 50))
    rules = ("window", "flow", "script")
    found = api.correlate_files(spark, [str(tmp_path / "in.jsonl")], None, 5, 5, None, rules)
    assert [p.name.split("-")[0] for p in set(tables.iterdir()) - before] == ["grouped"] and kinds == ["bigint"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false" and spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"
    plain = correlate.assign(found.events.drop("component"), correlate.links(found.events.drop("component"), 5, 5, None, rules))
    of = lambda df: {r.event_id: r.component for r in df.select("event_id", "component").collect()}
    assert of(found.events) == of(plain) and 1 < len(set(of(plain).values())) < len(lines)


def test_written_inputs_go_before_links_are_made(spark, tmp_path, monkeypatch):
    (tmp_path / "sf").mkdir()
    spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 7) AS ts, id % 5 AS user_id, element_at(array('click', 'signup', 'purchase', 'error'), 1 + CAST(id % 4 AS INT)) AS event_type, 1.5 AS value, concat('{\"k\": ', id % 30, '}') AS props FROM range(200)").write.parquet(str(tmp_path / "sf" / "events.parquet"))
    tables, there = Path(shared.session_dir(spark).removeprefix("file://")), []
    before = set(tables.rglob("part-*.txt")) if tables.exists() else set()
    ranked = correlate.ranked
    monkeypatch.setattr(correlate, "ranked", lambda events: there.append(set(tables.rglob("part-*.txt")) - before) or ranked(events))
    found = files._correlated(spark, str(tmp_path / "sf"))
    assert there == [set()] and found.events.count() == 200
    (tmp_path / "in.jsonl").write_text('{"ts":"2026-01-05T10:00:01Z","source":"npcap_live","pid":5}')
    assert api.correlate_files(spark, [str(tmp_path / "in.jsonl")]).events.count() == 1 and (tmp_path / "in.jsonl").exists()


def test_events_are_grouped_slice_by_slice(spark, tmp_path, monkeypatch):
    lines = [{"ts": f"2026-01-05T10:{i // 60 % 60:02d}:{i % 60:02d}Z", "source": "npcap_live", "pid": i % 90, "process_name": f"p{i % 7}.exe", "src_ip": f"10.0.0.{i % 3}", "dst_ip": f"8.8.8.{i % 9}"} for i in range(0, 3000, 7)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    left, assign = [], correlate.assign_ranked

    def watched(events, edges, path, slices, done):
        folder = Path(events.inputFiles()[0].removeprefix("file:")).parent.parent if "slice_" in events.columns else None
        return assign(events, edges, path, slices, lambda s: (done(s), left.append(folder and len(list(folder.glob("slice_=*"))))))

    def found(name):
        c = api.correlate_files(spark, [str(tmp_path / "in.jsonl")], None, 5, 5)
        c.write_document(str(tmp_path / name), "gzip")
        made = json.loads("".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / name).glob("part-*"))))
        return {r.event_id: r.component for r in c.events.collect()}, {(g["corr_id"], g["part"], g["total_occurrences"], len(g["events"])) for g in made["correlated_groups"]}

    monkeypatch.setattr(correlate, "assign_ranked", watched)
    one = found("one")
    monkeypatch.setattr(api, "SLICE_BYTES", 10_000)
    assert found("more") == one and 1 < len(set(one[0].values())) < len(lines)
    monkeypatch.setattr(correlate, "first_digits", lambda events: F.lit(7).cast("long"))
    assert found("dealt") == one
    n = (len(left) - 1) // 2
    assert left == [0, *range(n - 1, -1, -1), *[None] * n] and 3 <= n <= api.SLICES


def test_numbers_have_the_order_of_ids(spark):
    ids = ["f" * 64, "0" * 64, "0" * 15 + "1" * 49, "a" * 15, "9" * 64]
    of = lambda ids: {r.event_id: r.rank_ for r in correlate.ranked(spark.createDataFrame([(i,) for i in ids], "event_id string")).collect()}
    for some in (ids[1:2] + ids[3:], ids, [*ids, "x"], ids[:2] + ids[:1], ["b", "a", "c"]):
        found = of(some)
        assert sorted(found, key=found.get) == sorted(set(some)) and len(set(found.values())) == len(set(some))
    assert of(ids[:2]) == {"f" * 64: (1 << 60) - 1, "0" * 64: 0}


def test_written_inputs_are_compressed_and_written_events_go(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 7) AS ts, id % 50 AS user_id, element_at(array('click', 'signup', 'purchase', 'error'), 1 + CAST(id % 4 AS INT)) AS event_type, 1.5 AS value, concat('{\"k\": ', id % 30, '}') AS props FROM range(8000)").write.parquet(str(tmp_path / "sf" / "events.parquet"))
    paths = files._written(spark, str(tmp_path / "sf"))
    assert sum(p.stat().st_size for x in paths.values() for p in Path(x.removeprefix("file://")).glob("part-*")) < 8000 * 60
    tables = Path(shared.session_dir(spark).removeprefix("file://"))
    before = set(tables.glob("grouped-*"))
    expected = 8000 + sum(i % 4 == 0 and i % 7 != 0 and i % 10 == 1 for i in range(8000))
    assert files.group_document(spark, str(tmp_path / "sf")).first().total_events == expected
    assert files.whole_document(spark, str(tmp_path / "sf")).count() and set(tables.glob("grouped-*")) == before


def test_files_rotate_by_bytes(spark, tmp_path, monkeypatch):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, s string")
    for largest in (10**6, 50):
        monkeypatch.setattr(scan, "LARGEST", largest)
        out = tmp_path / str(largest)
        writers.write_rotated(df, str(out), 3000, ["event_id"])
        files = sorted((int(d.name.split("=")[1]), d) for d in out.iterdir() if d.name.startswith("file="))
        text = [text_of(d) for _, d in files]
        assert [i for i, _ in files] == list(range(len(files))) and all(len(list(d.glob("part-*"))) == 1 for _, d in files)
        assert [json.loads(x)["event_id"] for t in text for x in t.splitlines()] == list(range(500))
        assert all(len(t) < 3000 + 250 for t in text) and len(text) == -(-sum(map(len, text)) // 3000)


def test_rotated_events_by_the_bytes_of_their_sql(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    before, expected = 0, set()
    for i in range(5000):
        expected.add((before // 20_000, i))
        before += 16 + len(str(i))
    assert {(r.file, r.event_id) for r in files.rotated_files(spark, str(tmp_path)).collect()} == expected and len({f for f, _ in expected}) == 5


def test_counters_without_another_pass(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, i * 20_000_000) for i in range(90)], "event_id long, k long, us long")
    rows, seen = observed.counted(stateful.dedup_decisions(events, ["k"], 100), observed.decision_counts())
    rows.write.parquet(str(tmp_path / "rows"))
    made = rows.agg(F.count("*"), F.count_if("forwarded")).first()
    assert (seen.get["total"], seen.get["forwarded"], seen.get["compressed"]) == (made[0], made[1], made[0] - made[1])
    for i in range(3):
        spark.range(i * 10, i * 10 + 10 + i).select("id", (F.col("id") % 2 == 0).alias("forwarded")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, forwarded boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = observed.counted_stream(stream, "decisions", observed.decision_counts()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert observed.totals(q, "decisions") == {"total": 33, "forwarded": 17, "compressed": 16}


def test_a_model_is_the_same_when_loaded(spark, tmp_path):
    rows = [(i, 1 + i % 9, 1 + i % 4, 0, i * 1_000_000, ["a.exe"] * (i % 3), [], ["u"], ["f"], ["script_execution"] if i % 5 == 0 else ["network_connect"]) for i in range(200)] + [(999, None, None, None, None, None, None, None, None, None)]
    groups = spark.createDataFrame(rows, "component long, total_occurrences long, unique_events long, start_us long, end_us long, processes array<string>, dest_ips array<string>, users array<string>, source_files array<string>, record_types array<string>")
    bad = F.array_contains("record_types", "script_execution")
    model = risk.Model.trained(groups.withColumn("bad", bad), "bad")
    model.save(str(tmp_path / "model"))
    again = risk.Model.load(str(tmp_path / "model"))
    scores = {r.component: r.risk_score for r in model.scored(groups).collect()}
    assert {r.component: r.risk_score for r in again.scored(groups).collect()} == scores
    flagged = risk.with_features(groups)
    assert {r.component: r.t for r in flagged.select("component", again.threat(flagged).alias("t")).collect()} == {k: v >= 0.5 for k, v in scores.items()}
    assert all((v > 0.5) == (k % 5 == 0) for k, v in scores.items() if k != 999)


def test_strict_application_logs(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"source": s, "event_id": "1", "timestamp": "2026-01-05 10:00:00", "script_content": "x", "pattern_hits": 0}, indent=1) for s in ("WMI", "PowerShell", "Defender")))
    of = lambda n: sorted((r.record_type, r.process_name, r.source) for r in n.read(spark, str(tmp_path)).collect())
    assert of(readers.Normalizers.strict()) == [("script_execution", "powershell.exe", s) for s in ("Defender", "PowerShell", "WMI")]
    assert of(readers.Normalizers()) == [("defender", "", "Defender"), ("script_execution", "powershell.exe", "PowerShell"), ("wmi", "", "WMI")]


def test_sources_are_asked_once_for_what_is_new(spark):
    asked = []

    def service(targets):
        asked.append(sorted(r[0] for r in targets.collect()))
        return targets.select(*targets.columns, F.lit(80).alias("abuse_score"), F.lit(3).alias("malicious_count"), F.lit(0).alias("suspicious_count"))

    events = spark.createDataFrame([(i, i, f"8.8.8.{i % 3}", "d.example" if i == 5 else "") for i in range(9)], "event_id long, us long, dst_ip string, domain string").withColumns({"process_name": F.lit("p"), "protocol": F.lit("TCP"), "dst_port": F.lit(1), "direction": F.lit("OUTBOUND"), "record_type": F.lit("network_connect")})
    out = api.analyze(events, service, service, quota=50)
    assert [r.risk_score for r in out.results.orderBy("event_id").collect()] == [84, 84, 84, 100]
    assert asked == [["8.8.8.0", "8.8.8.1", "8.8.8.2"], ["8.8.8.0", "8.8.8.1", "8.8.8.2", "d.example"]]
    assert {r.ip: r.abuse_score for r in threat.ip_answers(threat.targets(events), service).collect()} == {f"8.8.8.{i}": 80 for i in range(3)}


def test_a_filter_of_bits_spares_reading_what_is_kept(spark, tmp_path):
    kept = seen.Filtered(spark, str(tmp_path / "kept"), ("a", "b"))
    key = lambda ids: ids.select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("x"), "id")).alias("b"), F.lit(True).alias("novel"))
    first, more, other = key(spark.range(3000)), key(spark.range(3000, 3100)), key(spark.range(10_000, 10_040))
    assert kept.seen(first).count() == 0
    for part in (first, more):
        kept.keep(part)
    found = {(r.a, r.b) for r in kept.candidates(first.unionByName(more)).collect()}
    assert found == {(r.a, r.b) for r in first.unionByName(more).select("a", "b").collect()}
    assert kept.candidates(other.where("b is not null")).count() <= 2  # of 32, bits are set by chance alone
    asked = kept.seen(more.limit(3))
    read = {f.split("part=")[1].split("/")[0] for f in asked.inputFiles()}
    assert 1 <= asked.select("a").count() < 100
    assert len(kept.candidates(more.limit(3)).select("part").distinct().collect()) <= 3 <= len(read)
