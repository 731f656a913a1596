"""What lies on disk between the depths of phrases."""

from __future__ import annotations

import random
from pathlib import Path

from lodewatch import shared
from lodewatch.llm import collocations


def test_a_depth_leaves_its_phrases_alone(spark, monkeypatch):
    r = random.Random(5)
    rows = [(("a", "b", None)[i % 3], " ".join(r.choice("u v w x y z".split()) for _ in range(60))) for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, text string")
    tables, there, release = Path(shared.session_dir(spark).removeprefix("file://")), [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = set(tables.iterdir()) if tables.exists() else set()
    discard = shared.discard

    def watched(spark, path):
        there.append(sum(bool(list(p.glob("part-*"))) or (p / "spelled=0").exists() for p in set(tables.iterdir()) - before if p.name.startswith(("shards-", "phrases-"))))
        discard(spark, path)

    monkeypatch.setattr(collocations, "discard", watched)
    written, released = collocations.written, []
    monkeypatch.setattr(collocations, "written", lambda df, name, **how: (released.append((name, spark.conf.get(release, "false"))), written(df, name, **how))[1])
    totals, counts = collocations.phrase_counts(df, 4, 5)
    left = [p for p in set(tables.iterdir()) - before]
    assert not [p for p in left if p.name.startswith("shards-") or (p / "spelled=0").exists()] and max(there) == 2 and len(there) == 5
    assert [x for n, x in released if n.startswith("phrases-")] == ["true"] * 5 and spark.conf.get(release, "false") == "false"
    expected = {}
    for lang, text in rows:
        words = text.split()
        for k in range(1, 6):
            for i in range(len(words) - k + 1):
                key = (lang or "und", " ".join(words[i : i + k]))
                expected[key] = expected.get(key, 0) + 1
    assert {(x.lang, x.phrase): x.f for x in counts.collect()} == {k: n for k, n in expected.items() if n >= 4}
    assert {x.lang: x.n for x in totals.collect()} == {"a": 1800, "b": 1800, "und": 1800}
