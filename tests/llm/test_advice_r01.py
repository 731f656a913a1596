"""Cases of the first round's review."""

import random

import corpus_pipeline

from lodewatch.llm import urlfilter
from lodewatch.llm.minhash import near_duplicates
from lodewatch.llm.outliers import FLOORS, REJECT, P, quality_rules, quantile

SYLLABLES = ("ka", "lo", "mi", "nu", "tér", "ra", "se", "do", "fin", "gan")


WORDS = [a + b + c for a in SYLLABLES for b in ("", *SYLLABLES) for c in ("", *SYLLABLES[:6])]


def prose(rng, n):
    """Words, some far more frequent than others, in lines of 8 to 14."""
    words = [WORDS[int(len(WORDS) * rng.random() ** 2)] for _ in range(n)]
    out, at = [], 0
    while at < n:
        size = rng.randint(8, 14)
        out.append(" ".join(words[at : at + size]))
        at += size
    return "\n".join(out)


def test_each_kind_of_junk_is_an_outlier(spark):
    rng = random.Random(7)
    clean = [prose(rng, rng.randint(40, 800)) for _ in range(300)]
    few = [f"{a}{b}" for a in SYLLABLES for b in ("ra", "se", "do")]
    lines = [f"w{rng.randrange(400)}" for _ in range(3000)]
    junk = {
        "repeated one-word lines": "\n".join(rng.choice(few) for _ in range(3000)),
        "repeated lines, more words": "\n".join(lines),
        "single letters": " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)),
        "hex tokens": " ".join("".join(rng.choice("0123456789abcdef") for _ in range(10)) for _ in range(100)),
        "doubled words": " ".join(f"{w} {w}" for w in prose(rng, 60).split()),
        "few distinct words": " ".join(rng.choice(few) for _ in range(600)),
    }
    rows = [(i, t, "en", "s") for i, t in enumerate([*clean, *junk.values()])]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for i, name in enumerate(junk, len(clean)):
        assert not got[i].base_failed and not got[i].kept, (name, got[i].distance)
    assert sum(not got[i].kept for i in range(len(clean)) if not got[i].base_failed) <= 3


def test_each_statistic_can_reject_alone():
    cut = quantile(REJECT, P) ** 0.5
    assert FLOORS[2] * cut < 4.6 and FLOORS[3] * cut < 3.04 and FLOORS[0] * cut < 0.4


def test_near_duplicates_of_each_text_of_an_id(spark):
    rng = random.Random(3)
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = []
    for i in range(0, 120, 6):
        one, two, three = (prose(rng, 90) for _ in range(3))
        # Id i has three unlike texts; each is linked with another id, by a near or an equal text.
        rows += [(i, one), (i, two), (i, three), (i + 1, near(one)), (i + 2, near(two)), (i + 3, near(three)), (i + 4, one), (1000 - i, three + "  ")]
    # Two ids that share a text, the larger of which has another one.
    text, other = prose(rng, 50), prose(rng, 50)
    rows += [(2001, text), (2005, text), (2005, other), (2003, near(other)), (2003, near(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.component_id) for r in near_duplicates(df, 80).collect()}
    group = lambda i: 2001 if i > 2000 else (1000 - i if i > 500 else i) // 6 * 6
    assert got == {(i, group(i)) for i, _ in rows}


def test_rules_of_rare_tokens_do_not_depend_on_size(spark):
    for n in (1000, 8000):
        urls = [(i, f"http://s{i % 7}.fine.io/a", i % 10 == 0) for i in range(n)] + [(n + i, f"http://evil.fine.io/b{'cd'[i % 2]}", i != 8) for i in range(12)]
        urls += [(n + 20 + i, "http://few.fine.io/a", True) for i in range(4)] + [(n + 30 + i, "http://mixed.fine.io/a", i % 2 == 0) for i in range(14)]
        df = spark.createDataFrame(urls, "page_id long, url string, bad boolean")
        got = {r.host for r in urlfilter.url_filter(df.select("page_id", "url"), df.select("page_id", "bad"), ()).where("verdict = 'block'").collect()}
        assert got == {"evil.fine.io"}, n


def test_pipeline_verdicts_are_of_rows(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: prose(rng, 90)
    again, lone, third = text(), text(), text()
    junk = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    rows = [(i, text()) for i in range(60)] + [(70, again), (70, junk), (None, lone), (None, junk)]
    df = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    passed = {(r.doc_id, r.text) for r in corpus_pipeline.rules_stage(spark, df(rows), str(tmp_path)).collect()}
    assert {(70, again), (None, lone)} <= passed and not [t for _, t in passed if t == junk]
    rows = [(5, again), (5, again), (9, again), (9, lone), (None, third), (None, third), (None, again), (3, text())]
    left = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df(rows), str(tmp_path)).collect())
    assert left == sorted([("3", rows[-1][1]), ("5", again), ("9", lone), ("None", third)])
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, text() if i < 60 else junk[i % 7 :]) for i in range(100)] + [(7, junk), (None, junk), (None, lone)]
    good = {(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, df(rows), str(tmp_path)).collect()}
    assert (7, rows[7][1]) in good and (None, lone) in good and not {(7, junk), (None, junk)} & good
