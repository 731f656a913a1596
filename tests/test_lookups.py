"""Tables of patterns, roots and networks against brute force."""

import ipaddress
import random

from pyspark.sql import functions as F

from lodewatch.functions import classify, tables
from lodewatch.operators import patterns, prefixes


def test_a_table_gives_what_the_literals_give(spark):
    rng = random.Random(1)
    words = [p for p, *_ in tables.SCRIPT_PATTERNS] + ["x", "Get-Item", "é", " "]
    texts = [None, ""] + ["".join(rng.choice(words).swapcase() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([(i, p, c, tables.SCRIPT_SEVERITIES.index(s)) for i, (p, c, s) in enumerate(tables.SCRIPT_PATTERNS)], "id long, pattern string, category string, severity int")
    found = patterns.severest(df, table, F.col("text")).withColumn("other", classify.script_match(F.col("text")))
    rows = found.select("match.severity", "match.category", F.col("other.severity").alias("s"), F.col("other.category").alias("c")).collect()
    assert len(rows) == len(texts) and all((r.severity, r.category) == (r.s, r.c) for r in rows) and any(r.s for r in rows)


def test_ten_thousand_patterns_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    table = [(i, word(rng.randint(1, 9))) for i in range(10_000)] + [(20_000, ""), (20_001, None), (20_002, "ABC")]
    texts = [None, "", *(word(rng.randint(0, 60)).upper() for _ in range(60))]
    df, known = spark.createDataFrame(list(enumerate(texts)), "k long, t string"), spark.createDataFrame(table, "id long, pattern string")
    expected = {k: sorted(i for i, p in table if p is not None and t is not None and p.lower() in t.lower()) for k, t in enumerate(texts)}
    for size in (8 << 20, 30_000):
        monkeypatch.setattr(patterns, "PART_BYTES", size)
        assert {r.k: r.hits for r in patterns.with_hits(df, known, F.col("t")).collect()} == expected


def test_patterns_that_many_rows_have_are_one(spark, monkeypatch):
    # 2000 rows have one of 40 patterns: results hold a number or one pattern, never the ids.
    table = [(i, f"W{i % 40:02d}", f"c{i % 3}", i % 7) for i in range(2000)] + [(5000, "", "all", -1), (5001, None, "none", 9)]
    texts = [None, "", "w01 W02", "w39w00", "none", " ".join(f"w{i:02d}" for i in range(40))]
    df, known = spark.createDataFrame(list(enumerate(texts)), "k long, t string"), spark.createDataFrame(table, "id long, pattern string, category string, severity int")
    inside = [[r for r in table if r[1] is not None and t is not None and r[1].lower() in t.lower()] for t in texts]
    best = [max(((s, -i, c) for i, _, c, s in rows), default=(None, None, None)) for rows in inside]
    for size in (8 << 20, 300):
        monkeypatch.setattr(patterns, "PART_BYTES", size)
        counted, match = patterns.with_counts(df, known, F.col("t")), patterns.severest(df, known, F.col("t"))
        assert {r.k: r.pattern_hits for r in counted.collect()} == {k: len(rows) for k, rows in enumerate(inside)}
        assert [tuple(r) for r in match.orderBy("k").select("match.severity", "match.order", "match.category").collect()] == best
        for found in (counted, match):
            plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            assert "array<bigint>" not in found._jdf.schema().catalogString() and "Generate" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


def test_parts_of_a_table_are_searched_in_turn(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PART_BYTES", 200)
    df, known = spark.createDataFrame([(1, "p001 p002 p199")], "k long, t string"), spark.createDataFrame([(i, f"p{i % 200:03d}") for i in range(400)], "id long, pattern string")
    counted = patterns.with_counts(df, known, F.col("t"))
    # Else a task would have a worker, and an automaton, for each part at once.
    assert counted._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r.pattern_hits for r in counted.collect()] == [6]


def test_texts_go_once_to_a_worker(spark, tmp_path, monkeypatch):
    """Of a query's columns only those that it needs are written between passes, beside the text itself."""
    from lodewatch.plans import lookups

    spark.sql("SELECT id AS doc_id, concat_ws(' ', 'Some words of', id, repeat(hex(id), 9), sha(CAST(id AS STRING))) AS text FROM range(60)").write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("SELECT id AS item_id, concat('xxwords of ', id) AS text FROM range(20)").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = {r.doc_id: r.pattern_hits for r in lookups.pattern_table_hits(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(patterns, "PART_BYTES", 100)
    passes, written = [], patterns.written
    monkeypatch.setattr(patterns, "written", lambda df, name, *a: (passes.append(df.columns) if name == "searched" else None) or written(df, name, *a))
    parts = {r.doc_id: r.pattern_hits for r in lookups.pattern_table_hits(spark, str(tmp_path)).collect()}
    assert parts == whole and sum(whole.values()) > 0
    assert passes and all(c == ["doc_id", "text_", "pattern_hits"] for c in passes)


def test_longest_roots(spark):
    rng = random.Random(3)
    path = lambda: "c:\\" + "\\".join(rng.choice(["Users", "win", "é", "w"]) for _ in range(rng.randint(0, 4)))
    roots = [(path()[: rng.randint(0, 14)], f"t{i}") for i in range(40)] + [(None, "n")]
    paths = [None, "", "d:\\x", *(path() for _ in range(200))]
    got = prefixes.longest_root(spark.createDataFrame(list(enumerate(paths)), "i long, p string"), "p", spark.createDataFrame(roots, "prefix string, trust string"))

    def expected(p):
        fits = [(len(r), r.lower()) for r, _ in roots if r is not None and p is not None and p.lower().startswith(r.lower())]
        return min(t for r, t in roots if r is not None and r.lower() == max(fits)[1]) if fits else "UNKNOWN"

    assert {r.i: r.location for r in got.collect()} == {i: expected(p) for i, p in enumerate(paths)}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_smallest_networks(spark):
    rng = random.Random(4)
    four = lambda: str(ipaddress.IPv4Address(rng.choice([0x0A000000, 0x08080000, 0]) + rng.randint(0, 1 << rng.choice([4, 16, 31]))))
    six = lambda: str(ipaddress.IPv6Address((rng.choice([0xFE80, 0x2001, 0]) << 112) + rng.randint(0, 1 << rng.choice([4, 64, 110]))))
    networks = [(f"{four()}/{rng.randint(0, 32)}", f"a{i}") for i in range(60)] + [(f"{six()}/{rng.randint(0, 128)}", f"b{i}") for i in range(60)] + [("8.8.8.8", "one"), ("::1", "loop"), ("1.2.3", "bad"), ("1.2.3.4/33", "bad"), ("fe80::/x", "bad"), (None, "bad")]
    addresses = [None, "", "300.1.1.1", "1::2::3", ":::", "fe80:::1", "12345::", "1:2:3:4:5:6:7", "8.8.8.8", "::1", "::", "FE80::A", "1:2:3:4:5:6:7:8", *(four() for _ in range(150)), *(six() for _ in range(150))]
    got = prefixes.longest_network(spark.createDataFrame(list(enumerate(addresses)), "i long, ip string"), "ip", spark.createDataFrame(networks, "network string, label string"))

    def parsed(f, x):
        try:
            return f(x)
        except ValueError:
            return None

    known = [(parsed(lambda x: ipaddress.ip_network(x, strict=False), n), t) for n, t in networks if n]

    def expected(a):
        a = parsed(ipaddress.ip_address, a or "")
        fits = [(n.prefixlen, t) for n, t in known if n is not None and a is not None and n.version == a.version and a in n]
        longest = max((x for x, _ in fits), default=None)
        return min((t for x, t in fits if x == longest), default=None)

    assert {r.i: r.network_label for r in got.collect()} == {i: expected(a) for i, a in enumerate(addresses)}
