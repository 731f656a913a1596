"""Fingerprints and the discriminant against plain versions, written another way."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewatch.llm import fuzzyhash, textkernels
from lodewatch.llm.fuzzyhash import fingerprints

ALL = (1 << 64) - 1
BASE = textkernels._BASE
BYTES = textkernels._BYTE.tolist()


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * factor & ALL
    return x


def hashed(piece):
    return mixed(sum(BYTES[b] * pow(BASE, i, 1 << 64) for i, b in enumerate(piece)) & ALL)


def plain_fingerprint(text):
    """Byte by byte, each window and piece hashed by itself."""
    data = text.encode()
    if not data:
        return "3::"
    rolling = [hashed(data[max(0, i - 6) : i + 1]) >> 32 for i in range(len(data))]

    def pieces(block):
        out, begin = [], 0
        for i, r in enumerate(rolling):
            if r % block == block - 1:
                out.append(data[begin : i + 1])
                begin = i + 1
        return out, data[begin:]

    def letters(block):
        ended, rest = pieces(block)
        return "".join(fuzzyhash.ALPHABET[hashed(p) & 63] for p in ended + [rest] * bool(rest))

    block = 3
    while block * 64 < len(data):
        block *= 2
    low = max(3, block // 2)
    while len(pieces(block)[0]) >= 64:
        block *= 2
    if len(pieces(block)[0]) + 1 < 32 and block > low and len(pieces(block // 2)[0]) < 64:
        block //= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_likeness(f, g):
    if f == g:
        return 1.0

    def like(a, b):
        k = min(4, len(a), len(b))
        if a == b:
            return 1.0
        if not k or not any(a[i : i + k] in b for i in range(len(a) - k + 1)):
            return 0.0
        return 1 - distance(a, b) / max(len(a), len(b))

    (m, *f), (n, *g) = f.split(":"), g.split(":")
    same = [(f[i], g[j]) for i in (0, 1) for j in (0, 1) if int(m) * 2**i == int(n) * 2**j]
    return max((like(a, b) for a, b in same), default=0.0) if f[0] and g[0] else 0.0


def test_fingerprints_and_likeness_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinrstlé") for _ in range(rng.randint(1, 9)))
    texts = [None, "", "x", "é" * 7] + [" ".join(word() for _ in range(rng.choice([3, 20, 90, 300]))) for _ in range(30)]
    texts += [texts[-1], texts[-2] + " more", texts[-3][40:]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    chain = sorted(rows, reverse=True)
    for (i, t), (_, other) in zip(chain, [*chain[1:], chain[0]], strict=True):
        t, other = t or "", other or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + other[:k]
        f, e, n = map(plain_fingerprint, (t, changed, other))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), f, e)
        assert r.near_edited == pytest.approx(plain_likeness(f, e)) and r.near_next == pytest.approx(plain_likeness(f, n))


def test_scores_are_those_of_a_plain_discriminant(spark):
    """Class densities by whole covariance matrices, their inverses and determinants, from rows in numpy."""
    from lodewatch.llm import quality as Q
    from lodewatch.llm.textstats import text_counts

    rng = random.Random(12)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta words of plain prose".split()) for _ in range(rng.randint(0, 90))) + "."
    bad = lambda: "\n".join(rng.choice(["BUY NOW!!!", "### ***", "click click click", "plain line"]) for _ in range(rng.randint(1, 30)))
    rows = [(i, (good if i % 3 else bad)()) for i in range(240)] + [(900, None), (901, ""), (None, "no id")]
    told = [(i, int(i % 3 > 0) if rng.random() < 0.9 else int(i % 3 == 0)) for i in range(0, 200)] + [(5, 1), (6, None), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(told, "doc_id long, quality int")
    columns = Q.statistics()
    counted = text_counts(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), more=True)
    x = {r[0]: np.array(r[1:], float) for r in counted.select("id", *columns.values()).collect()}
    away = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    of = [np.array([x[i] for i, q in told if q == k and i in x and not away(i)]) for k in (0, 1)]
    cov = [np.cov(m.T, bias=True) for m in of]
    n = np.array([len(m) for m in of], float)
    target = np.diag(np.maximum((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / n.sum(), Q.LEAST_VARIANCE))

    def density(v, k):
        c = (1 - Q.SHRINKAGE) * cov[k] + Q.SHRINKAGE * target
        d = v - of[k].mean(axis=0)
        return np.log(n[k] / n.sum()) - 0.5 * (np.linalg.slogdet(c)[1] + d @ np.linalg.inv(c) @ d)

    got = Q.quality(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        expected = 1 / (1 + np.exp(min(density(x[r.doc_id], 0) - density(x[r.doc_id], 1), 700.0)))
        assert r.score == pytest.approx(expected, abs=1e-8) and r.held_out == away(r.doc_id)
        assert r.predicted == int(r.score >= 0.3)
