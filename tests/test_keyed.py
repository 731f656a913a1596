"""Streams with maps and timers: capacity, hand-over from an earlier run, and what the state store holds."""

import random

from pyspark.sql import functions as F

from lodewatch.streaming import keyed


def run(stream, folder, name):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}").collect()]


def source(spark, rows, schema, folder, files=3):
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us"))
    for i in range(files):  # in the order of time, a file a micro-batch
        df.where((F.col("event_id") * files / len(rows)).cast("int") == i).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def table(rows, most, idle, watermark):
    """The flow table in a loop; timers fire at the end only, as the watermark lags behind every gap."""
    flows, ended = {}, []
    for i, us, host, key, direction, state, size in rows:
        old = flows.pop((host, key), None)
        if old and us - old[1] > idle:
            ended.append((host, key, *old, "idle"))
            old = None
        own = {k: v for k, v in flows.items() if k[0] == host}
        if old is None and len(own) >= most:
            gone = min(own, key=lambda k: (own[k][1], k[1]))
            ended.append((*gone, *flows[gone], "idle" if us - flows[gone][1] > idle else "capacity"))
            del flows[gone]
        old = old or (us, us, 0, 0, 0, "")
        flows[host, key] = (old[0], us, old[2] + 1, old[3] + size * (direction == "OUTBOUND"), old[4] + size * (direction != "OUTBOUND"), state)
    return ended + [(*k, *v, "idle") for k, v in flows.items() if (v[1] + idle) // 1000 <= watermark]


def test_a_full_flow_table_ends_the_one_not_seen_for_longest(spark, tmp_path):
    keyed.store(spark)
    rng = random.Random(1)
    rows = [(i, 86_400_000_000 + i * 1_000_000, rng.choice("ab"), f"10.0.0.{rng.randint(0, 9)}", rng.choice(["OUTBOUND", "INBOUND", "UNKNOWN"]), rng.choice(["SYN_SENT", "CLOSED"]), rng.randint(0, 9)) for i in range(300)]
    stream = source(spark, rows, "event_id long, us long, host string, ip string, direction string, tcp_state string, bytes long", tmp_path / "in")
    got = run(keyed.flow_table_stream(stream, "host", ["ip"], 400, 4, "1 hour"), tmp_path, "out")
    assert sorted(got) == sorted(table(rows, 4, 400_000_000, 0))
    assert any(r[-1] == "capacity" for r in got)
    held = spark.read.format("statestore").option("path", f"{tmp_path}/out-log").option("stateVarName", "flows").load()
    assert {r.host: r.n for r in held.groupBy(F.col("key.host").alias("host")).agg(F.count("*").alias("n")).collect()} == {"a": 4, "b": 4}


def test_open_buckets_are_handed_over(spark, tmp_path):
    keyed.store(spark)
    s = 1_000_000
    rows = [(0, 10 * s, "d", 1, "x", "write", False), (1, 11 * s, "d", 1, "x", "delete", False), (2, 12 * s, "d", 1, "y", "delete", True), (3, 900 * s, "e", 1, "z", "write", False), (4, 2000 * s, "e", 2, "q", "write", False)]
    stream = source(spark, rows, "event_id long, us long, directory string, pid int, path string, action string, elevated boolean", tmp_path / "in", 2)
    before = spark.createDataFrame([("d", 1, "y", True, 3, 2, 1, 5 * s, 6 * s)], "directory string, pid int, path string, file_elevated boolean, created long, deleted long, elevated long, first_us long, last_us long")
    got = run(keyed.bucket_stream(stream, idle_s=60, watermark="1 second", initial=before), tmp_path, "out")
    # The bucket of d held y already elevated: x comes and goes, then y goes; e's first is idle at the end, its second still open.
    assert sorted(got) == [("d", 1, 4, 4, 1, 5 * s, 12 * s, "empty"), ("e", 1, 1, 0, 0, 900 * s, 900 * s, "idle")]
    held = spark.read.format("statestore").option("path", f"{tmp_path}/out-log").option("stateVarName", "files").load()
    assert [r.key.directory for r in held.collect()] == ["e"]
