"""Mined URL rules against a miner by brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodewatch.llm import urlfilter as U


def brute(rows, support, confidence):
    """Rules as sets of tokens, over all sets of up to three tokens of any labelled URL."""
    rows = [(set(t), b) for t, b in rows if t]
    where = defaultdict(set)
    for i, (t, _) in enumerate(rows):
        for x in t:
            where[x].add(i)
    rep = {}
    for x in sorted(where):
        rep.setdefault(frozenset(where[x]), x)
    own = [({rep[frozenset(where[x])] for x in t}, b) for t, b in rows]
    n, bad, least = Counter(), Counter(), max(U.LEAST_COUNT, math.ceil(support * len(rows)))
    for t, b in own:
        for k in range(1, U.MOST_TOKENS + 1):
            for c in combinations(sorted(t), k):
                n[c] += 1
                bad[c] += b
    candidates = [c for c in n if bad[c] >= (U.LEAST_COUNT if len(c) == 1 else least)]
    base = sum(b for _, b in rows) / len(rows)
    term = lambda p, q: p * math.log(p / q) if p > 0 else 0.0
    out = set()
    for c in candidates:
        p = bad[c] / n[c]
        if p > max(confidence, base) and n[c] * (term(p, base) + term(1 - p, 1 - base)) >= math.log(len(candidates) / U.ALPHA) - 1e-9:
            out.add(c)
    return out, {x: rep[frozenset(where[x])] for x in where}


def urls(rng, n):
    out = []
    for _ in range(n):
        host = f"{rng.choice('abcd')}.{rng.choice(('one', 'two', 'three'))}.{rng.choice(('io', 'org'))}"
        path = "/".join(rng.choice(("news", "shop", "win", "cash", "blog")) for _ in range(rng.randint(0, 3)))
        out.append(f"http://{host}/{path}")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    pages = [(i, u) for i, u in enumerate(urls(rng, 900))]
    told = lambda u: rng.random() < (0.95 if "win" in u and "cash" in u else 0.8 if "two" in u and "shop" in u else 0.1)
    labels = [(i, told(u)) for i, u in pages[:600]]
    df = spark.createDataFrame(pages, "page_id long, url string")
    host, path = U.parsed(F.col("url"))
    tokens = {r.page_id: r.t for r in df.select("page_id", U.tokens(host, path).alias("t")).collect()}
    want, rep = brute([(tokens[i], b) for i, b in labels], 0.01, 0.5)
    labelled = spark.createDataFrame([(i, tokens[i], b) for i, b in labels], "row long, tokens array<string>, bad boolean")
    got, classes = U.mined_rules(labelled, 0.01, 0.5)
    assert {tuple(r.tokens) for r in got.collect()} == want and len(want) >= 2
    assert {r.token: r.rep for r in classes.collect()}.items() <= rep.items()
    verdicts = {r.page_id: r.verdict for r in U.url_filter(df, spark.createDataFrame(labels, "page_id long, bad boolean"), (), support=0.01).collect()}
    blocked = {i for i, t in tokens.items() if any(set(c) <= {rep.get(x) for x in t} for c in want)}
    assert {i for i, v in verdicts.items() if v == "block"} == blocked and blocked


def test_no_rule_comes_from_chance(spark):
    rng = random.Random(5)
    df = spark.createDataFrame(list(enumerate(urls(rng, 2000))), "page_id long, url string")
    labels = spark.createDataFrame([(i, rng.random() < 0.3) for i in range(2000)], "page_id long, bad boolean")
    assert U.url_filter(df, labels, ()).where("verdict = 'block'").isEmpty()


def test_many_shared_tokens_stay_bounded(spark):
    rng = random.Random(6)
    path = "/".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))
    pages = [(i, f"http://bad.io/{path}" if i % 2 else f"http://x{rng.choice('abc')}.io/" + "/".join(rng.sample(path.split("/"), 35))) for i in range(200)]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(200)], "page_id long, bad boolean")
    out = U.url_filter(spark.createDataFrame(pages, "page_id long, url string"), labels, ())
    assert {r.page_id for r in out.where("verdict = 'block'").collect()} == {i for i in range(200) if i % 2}


@pytest.mark.parametrize(("items", "seed"), [(12, 3), (3, 4), (1, 5)])
def test_rules_of_tokens_beyond_the_bound(spark, items, seed):
    """URLs have more frequent tokens than FP-growth takes; rules need common ones, alone, in pairs and in triples."""
    rng = random.Random(seed)
    rare = [f"r{chr(97 + i)}" for i in range(14)]
    rows = []
    for i in range(500):
        t = {x for x in rare if rng.random() < 0.4} | {x for x in ("uu", "vv", "ww") if rng.random() < 0.7}
        told = 0.95 if {"uu", "vv", "ww"} <= t else 0.9 if {"ra", "vv"} <= t else 0.1
        rows.append((i, sorted("p:" + x for x in t), rng.random() < told))
    want, _ = brute([(t, b) for _, t, b in rows], 0.02, 0.5)
    got, _ = U.mined_rules(spark.createDataFrame(rows, "row long, tokens array<string>, bad boolean"), 0.02, 0.5, most_items=items)
    assert Counter(tuple(r.tokens) for r in got.collect()) == Counter(want)
    assert ("p:uu", "p:vv", "p:ww") in want
