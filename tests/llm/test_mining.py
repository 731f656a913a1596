"""SimHash, collocations and hard negatives against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodewatch.llm import hardneg, simhash as sim
from lodewatch.llm.collocations import Automaton, collocations
from lodewatch.llm.hardneg import hard_negatives
from lodewatch.llm.simhash import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- SimHash


def plain_fingerprint(text, k=4):
    words = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, near):
    label = {i: i for i in ids}
    while True:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            for x in (a, b):
                changed |= label[x] != low
                label[x] = low
        if not changed:
            return label


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    for i in range(0, 600, 2):
        values[i + 1] = values[i]
        for b in rng.choice(64, rng.integers(0, 10), replace=False):
            values[i + 1] ^= np.uint64(1 << int(b))
    expected = set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(values[:, None] ^ values) <= radius)), strict=True))
    a, b = sim.near(values, sim.sliced(values), len(values), radius, last=0xFF00)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected


@pytest.mark.parametrize("n", [1, 10_000, 10**6, 10**8, 10**10])
def test_each_near_pair_shares_a_bucket(n):
    rng = random.Random(n)
    masks = sim.tables(n)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("sizes", [(2048, 2048), (4, 5)])
def test_simhash(spark, monkeypatch, sizes):
    """All rows in one bucket of one block, and many tables of buckets in many blocks."""
    monkeypatch.setattr(sim, "BUCKET", sizes[0]), monkeypatch.setattr(sim, "BLOCK", sizes[1])
    rng = random.Random(5)
    words = [a + b for a in "bcdfgk" for b in "aeiou"]
    rows = []
    for i in range(120):
        w = [rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 300))]
        if i % 3 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "x").split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "Changed"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "Éa ÀB c"), (204, "éa"), (7, "another text of one id"), (205, "another text of one id"), (206, rows[3][1].upper()), (206, rows[3][1].upper()), (None, rows[3][1]), (None, None), (207, "w " * 50_000)]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fp string, component long").repartition(5)
    got = simhash(df).collect()
    marks = [(i, plain_fingerprint(t)) for i, t in rows]
    known = [(i, f) for i, f in marks if i is not None]
    near = [(a, b) for x, (a, f) in enumerate(known) for b, g in known[:x] if (f ^ g).bit_count() <= 4]
    label = least_reachable({i for i, _ in known}, near)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", label.get(i)) for i, f in marks)
    assert len(set(label.values())) < len(label) - 20
    assert simhash(df.where("doc_id > 900")).collect() == []


# --- Collocations


def test_automaton_has_the_states_of_all_phrases():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, depth = int(rng.integers(0, 120)), int(rng.integers(1, 6))
        words = rng.integers(-1, rng.integers(1, 6), n).astype(np.int32)
        ends = defaultdict(list)
        for i in range(n):
            for d in range(1, min(depth, i + 1) + 1):
                if (words[i - d + 1 : i + 1] < 0).any():
                    break
                ends[tuple(words[i - d + 1 : i + 1].tolist())].append(i)
        made = Automaton.of(words, depth)
        phrase = lambda end, length: tuple(words[end - length + 1 : end + 1].tolist())  # noqa: B023, E731
        found = {phrase(e, k): c for e, k, c in zip(*(x.tolist() for x in made.phrases(1, depth)), strict=True)}
        assert found == {k: len(v) for k, v in ends.items()}
        states = defaultdict(list)
        for k, v in ends.items():
            states[tuple(v)].append(len(k))
        assert len(states) == len(made.count)
        for s, (short, long, end, link) in enumerate(zip(made.shortest.tolist(), made.longest.tolist(), made.end.tolist(), made.link.tolist(), strict=True)):
            own = states[tuple(ends[phrase(end, long)])]
            assert (min(own), max(own)) == (short, long)
            if short == 1:
                assert link == -1
            else:
                assert made.longest[link] == short - 1 and link != s
                assert phrase(made.end[link], short - 1) == phrase(end, short - 1)


def plain_collocations(rows, least, words, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    inside = lambda s, t: len(s) < len(t) and any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    by_lang = defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(m == lang and inside(p, q) and 100 * b >= percent * a for (m, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return Counter((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:top]))


@pytest.mark.parametrize(("least", "percent", "top", "shard"), [(3, 100, 2000, 8 << 20), (2, 60, 15, 300), (5, 100, 7, 2000)])
def test_collocations(spark, monkeypatch, least, percent, top, shard):
    import lodewatch.llm.collocations as module

    monkeypatch.setattr(module, "SHARD_BYTES", shard), monkeypatch.setattr(module, "OPEN_BYTES", 2 * shard)
    rng = random.Random(least)
    vocabulary = ["the", "Of", "über", "a", "b", "c d", "x's", "\U0001f600"]
    rows = []
    for i in range(150):
        w = rng.choices(vocabulary, [9, 7, 2, 3, 3, 1, 1, 1], k=rng.randint(0, 60))
        w = [x + rng.choice(["", "", "", ".", ",\t", "\n", "!?", "\x0b"]) for x in w]
        rows.append((rng.choice(["en", "en", "en", "de", None]), " ".join(w) + " New  York City hall" * (i % 3)))
    rows += [("en", None), (None, ""), ("fr", "..."), ("en", "aa aa aa aa aa aa " * 400), ("es", rows[0][1]), ("es", rows[0][1]), ("es", rows[0][1])]
    df = spark.createDataFrame([(lang, t, 1, "n") for lang, t in rows], "lang string, text string, n int, shard string").repartition(3)
    got = collocations(df, least, 5, percent, top).collect()
    assert Counter(tuple(r) for r in got) == plain_collocations(rows, least, 5, percent, top)
    assert collocations(df.where("lang = 'none'"), least).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits for counts that a test can't write; the expression is the operator's."""
    row = spark.range(1).select(F.lit(9 * 10**12).alias("a"), F.lit(5 * 10**13).alias("n"), F.lit(10**13 + 1).alias("l"), F.lit(2 * 10**13 + 3).alias("r"))
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(19,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
    assert row.select(score.alias("s")).first().s == 1000 * 9 * 10**12 * 5 * 10**13 // ((10**13 + 1) * (2 * 10**13 + 3))


# --- Hard negatives


def plain_negatives(rows, is_anchor, positives, negatives, low, high):
    def q(v):
        return [math.floor(256 * x) for x in v]

    known = [(i, label, q(v)) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in known:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in known if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return Counter(out)


@pytest.mark.parametrize(("block", "group", "few"), [(1 << 20, 8, 0.02), (600, 2, 0.5), (600, 1, 0.0)])
def test_hard_negatives(spark, monkeypatch, block, group, few):
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", block), monkeypatch.setattr(hardneg, "GROUP", group), monkeypatch.setattr(hardneg, "FEW", few)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.3, (4, 12))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.2, 12)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    same = rows[0][1]
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # ties
    rows += [(None, same, 1), (2000, None, 1), (2001, same, None), (2002, [float("nan")] * 12, 1), (2003, [1.0, None], 1), (2004, [float("inf")], 1), (2005, [], 1), (2010, [0.5, -0.25, 0.125], 2), (2020, [0.0] * 12, 0), (2030, same, 0), (2030, same, 0)]
    df = spark.createDataFrame([(i, v, label, "a", 1.0) for i, v, label in rows], "vec_id long, embedding array<double>, label int, ids string, q double").repartition(4)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, 4, 3, 50, 95).collect()
    expected = plain_negatives(rows, lambda i: i % 10 == 0, 4, 3, 50, 95)
    assert Counter(tuple(r) for r in got) == expected
    assert len(expected) > 100
    assert hard_negatives(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives(df, F.lit(None).cast("boolean")).collect() == []


def test_bounds_discard_most_pairs():
    """With a few strong directions, most pairs are gone before their last component, and none that counts."""
    rng = np.random.default_rng(4)
    q = np.floor(256 * (rng.normal(0, 1, (900, 4)) @ rng.normal(0, 1, (4, 32)) * 0.2 + rng.normal(0, 0.02, (900, 32)))).astype(np.int64)
    values, vectors = np.linalg.eigh((q.T @ q).astype(float))
    ids, labels = np.arange(900), np.zeros(900, np.int64)
    side = hardneg.Side(ids.tobytes(), labels.tobytes(), q.tobytes(), np.ascontiguousarray(vectors[:, ::-1]))
    scores = q @ q.T
    least = np.sort(scores, axis=1)[:, -6].astype(float)
    i, j = hardneg.survivors(side, side, np.ones((900, 900), bool), least, np.full(900, np.inf), 0)
    assert set(zip(*(x.tolist() for x in np.nonzero(scores >= least[:, None])), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.05 * 900 * 900
    assert (hardneg.products(side, side, i, j) == scores[i, j]).all()
