"""Running values by windows and by ranges: the same rows, and no task with most of a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from lodewatch.operators import aggregates, capture, correlate, scan, stateful
from lodewatch.operators.scan import last, running, total

ODD = "event_id long, us long, pid long, v string, n int"


def rows_of(n, hot, seed=3):
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.02 else 7 if rng.random() < hot else rng.randint(0, 40)
    return [(i, None if rng.random() < 0.01 else rng.randint(0, 5000) * 1000, key(), rng.choice([None, None, "a", "b", "c"]), rng.choice([None, 0, 1, 5])) for i in range(n)]


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
def test_ranges_give_what_windows_give(spark, monkeypatch, hot, reverse):
    rows = rows_of(3000, hot)
    events = spark.createDataFrame(rows, ODD)
    values = {"x": last(F.col("v")), "y": last(F.col("v"), before=True), "s": total(F.col("n")), "t": total(F.col("n") > 0, before=True), "z": last(F.when(F.col("n") == 5, F.struct("us", "v")), before=True)}
    for keys in (["pid"], ["pid", "v"], []):
        made = [sorted(map(str, running(events, keys, values, reverse=reverse).collect()))]
        with monkeypatch.context() as m:
            m.setattr(scan, "LARGEST", 0)
            made.append(sorted(map(str, running(events, keys, values, reverse=reverse).collect())))
        assert made[0] == made[1]
    # By hand, under one key.
    got = {r.event_id: r for r in running(events.where("pid = 7"), ["pid"], values, reverse=reverse).collect()}
    at, s = None, 0
    for r in sorted((r for r in rows if r[2] == 7), key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=reverse):
        assert (got[r[0]].y, got[r[0]].s - (r[4] or 0)) == (at, s)
        at, s = r[3] or at, s + (r[4] or 0)
        assert got[r[0]].x == at


def test_one_key_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "LARGEST", 1000)
    events = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") * 13 % 20_011).alias("us"), F.lit(1).alias("pid"))
    dealt = {}
    original = scan.written

    def looked_at(df, name):
        out = original(df, name)
        dealt.update({r.range_: r.n for r in out.groupBy("range_").agg(F.count("*").alias("n")).collect()})
        return out

    monkeypatch.setattr(scan, "written", looked_at)
    out = running(events, ["pid"], {"place": total(F.lit(1))}, ("us", "event_id"))
    assert out.agg(F.count_distinct("place"), F.max("place")).first()[:] == (20_000, 20_000)
    assert len(dealt) >= 3 and max(dealt.values()) < 3 * 20_000 / len(dealt)


def test_operators_are_the_same_both_ways(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 900) * 1_000_000, rng.choice([1, 1, 1, 2, 3]), rng.choice(["start", "stop", "thread", "x"]), rng.choice("abc"), rng.choice(["", "p", "q"]), rng.choice([0, 14, 18, 64])) for i in range(900)]
    events = spark.createDataFrame(rows, "event_id long, us long, pid long, kind string, child_name string, path string, opcode int").withColumns({"parent_pid": F.col("pid"), "file_key": F.col("pid"), "device": F.col("pid"), "action": F.when(F.col("kind") == "start", "write").otherwise("close")})
    event = events.withColumns({"record_type": F.when(F.col("kind") == "start", "process_start").otherwise("script_execution"), "process_name": F.lit("PowerShell.exe"), "host_id": F.col("child_name")})
    made = {
        "latest": lambda: aggregates.parents(events), "stops": lambda: aggregates.stop_identity(events), "children": lambda: aggregates.child_counts(events), "sessions": lambda: stateful.sessions(events, ["pid"], 5),
        "paths": lambda: capture.resolved_paths(events), "devices": lambda: capture.device_sessions(events.withColumn("kind", F.when(F.col("kind") == "start", "arrival").when(F.col("kind") == "stop", "removal").otherwise("read"))),
        "writes": lambda: aggregates.coalesced_writes(events), "gap": lambda: correlate.same_pid(event, 3), "near": lambda: correlate.nearest_process(event, 4), "near of all hosts": lambda: correlate.nearest_process(event.drop("host_id"), 4),
    }
    expected = {k: sorted(map(str, f().collect())) for k, f in made.items()}
    assert all(expected.values())
    monkeypatch.setattr(scan, "LARGEST", 0)
    assert {k: sorted(map(str, f().collect())) for k, f in made.items()} == expected


def test_links_stay_within_a_host(spark):
    rows = [(i, i * 1000, "ab"[i % 2], 5, "tool.exe", "u", "10.0.0.1", "8.8.8.8", ["INBOUND", "OUTBOUND"][i // 2 % 2], f"f{i % 3}", "process_start" if i % 4 else "script_execution") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, us long, host_id string, pid long, process_name string, user_name string, src_ip string, dst_ip string, direction string, source_file string, record_type string").withColumns({"src_port": F.lit(1), "dst_port": F.lit(2)})
    for rule in correlate.RULES:
        for e in correlate.links(events, rules=[rule])[0].collect() if rule != "script" else correlate.nearest_process(events, name="tool").collect():
            assert e.a % 2 == e.b % 2, rule
    assert correlate.assign(events, correlate.links(events)).select("component").distinct().count() == 2
    assert correlate.assign(events.drop("host_id"), correlate.links(events.drop("host_id"))).select("component").distinct().count() == 1


@pytest.mark.parametrize("shape", ["one key", "many keys", "bursts"])
def test_anchors_over_ranges_are_those_of_the_fold(spark, monkeypatch, shape):
    rng = random.Random(len(shape))
    time = lambda: rng.choice([0, 1, 50, 51]) * 10_000_000 + rng.randint(0, 900) if shape == "bursts" else rng.randint(0, 900_000_000)
    rows = [(i, None if rng.random() < 0.01 else time(), None if shape == "many keys" and rng.random() < 0.05 else "k" if shape != "many keys" or rng.random() < 0.6 else rng.choice("abcdef")) for i in range(4000)]
    events = spark.createDataFrame(rows, "event_id long, us long, key string")
    for reach in (300, 2_000_000, 61_000_000, 10**12):
        expected = sorted(map(str, stateful.anchored(events, ["key"], reach).collect()))
        with monkeypatch.context() as m:
            m.setattr(scan, "LARGEST", 100), m.setattr(stateful, "RANGE", 150)
            assert sorted(map(str, stateful.anchored(events, ["key"], reach).collect())) == expected
