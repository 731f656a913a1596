"""What lies on disk while events are grouped, and after."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from lodewatch import api, shared
from lodewatch.operators import components, correlate
from lodewatch.plans import files
from lodewatch.sources import writers


def _tables(spark) -> Path:
    return Path(shared.session_dir(spark).removeprefix("file://"))


def _events(spark, path: Path, n: int = 900) -> str:
    path.mkdir()
    spark.sql(f"SELECT id AS event_id, timestamp_seconds(1700000000 + id * 1900) AS ts, id % 50 AS user_id, element_at(array('click', 'signup', 'purchase', 'error'), 1 + CAST(id % 4 AS INT)) AS event_type, 1.5 AS value, concat('{{\"k\": ', id % 29, '}}') AS props FROM range({n})").write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["files_to_groups", "group_search"])
def test_groups_keep_no_events(spark, tmp_path, monkeypatch, name):
    sf = _events(spark, tmp_path / "sf")
    made = getattr(files, name)
    before = set(_tables(spark).glob("grouped-*")) if _tables(spark).exists() else set()
    out = made(spark, sf)
    rows = sorted(map(str, out.collect()))
    assert rows and set(_tables(spark).glob("grouped-*")) == before
    monkeypatch.setattr(api, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(api, "SHARE", 1)
    assert sorted(map(str, made(spark, sf).collect())) == rows


def test_rules_are_linked_one_after_the_other(spark, tmp_path, monkeypatch):
    of, kind = [], type(spark.range(1))
    written = kind.write.fget

    def watched(df):
        if df.columns == ["a", "b"]:
            of.append(1)
        return written(df)

    monkeypatch.setattr(kind, "write", property(watched))
    tables = [spark.createDataFrame(x, "a long, b long") for x in ([(1, 2), (2, 2)], [(5, 2)], [(7, 8)])]
    found = components.components(components.Links(tables))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 5: 1, 7: 7, 8: 7} and len(of) == 3


def test_steps_of_components_go_by_slices_of_the_nodes(spark, monkeypatch):
    links = [(i, i * 7 % 400) for i in range(300)] + [(i, i + 1) for i in range(500, 600)] + [(i * 3 % 200 + 700, 700) for i in range(300)]
    df = spark.createDataFrame(links + links[:50], "a long, b long")
    of = lambda: {r.node: r.component for r in components.components(df, 10).collect()}
    whole, names = of(), []
    written = components.written
    monkeypatch.setattr(components, "SLICE_LINKS", 100)
    monkeypatch.setattr(components, "SLICES", 2)
    monkeypatch.setattr(components, "written", lambda df, name, path=None: names.append(name) or written(df, name, path))
    assert of() == whole and components.components(df, 10).count() == len(whole)
    assert names.count("least") % (2 * components.SLICES) == 0 and names


def test_one_group_of_all_events_is_collapsed_in_slices(spark, tmp_path, monkeypatch):
    lines = [{"ts": f"2026-01-05T10:{i // 60 % 60:02d}:{i % 60:02d}Z", "source": "npcap_live", "pid": 1, "process_name": f"p{i % 7}.exe", "src_ip": f"10.0.{i % 2}.{i % 200}", "dst_ip": f"8.8.8.{i % 9}"} for i in range(2500)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    sizes, collapse = [], correlate.collapse

    def found(name):
        c = api.correlate_files(spark, [str(tmp_path / "in.jsonl")], None, 5, 5)
        c.write(str(tmp_path / name), delete=True)
        rows = spark.read.json(str(tmp_path / name / "groups")).selectExpr("part", "total_occurrences", "size(events) AS n", "md5(to_json(events)) AS h").collect()
        assert not Path(c.path.removeprefix("file://")).exists()
        return sorted(map(tuple, rows))

    one = found("one")
    monkeypatch.setattr(api, "SLICE_BYTES", 50_000)
    monkeypatch.setattr(correlate, "collapse", lambda grouped, *a: sizes.append(grouped.count()) or collapse(grouped, *a))
    assert found("more") == one and len(one) > 1 and {r[1] for r in one} == {2500}
    assert len(sizes) > 3 and sum(sizes) == 2500 and max(sizes) < 2500


def test_arrays_of_a_group_are_in_its_first_line_alone(spark, tmp_path, monkeypatch):
    # A pid's events are minutes apart, and so are one group.
    spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 60) AS ts, id % 2 AS user_id, element_at(array('click', 'signup', 'purchase', 'error'), 1 + CAST(id % 4 AS INT)) AS event_type, 1.5 AS value, concat('{\"k\": ', id % 29, '}') AS props FROM range(600)").write.parquet(str(tmp_path / "sf" / "events.parquet"))
    lines = []
    read = files.readers.threat_events

    def watched(spark, path, by_line):
        lines.extend(json.loads(r.value) for r in spark.read.text(path).select("value").collect())
        return read(spark, path, by_line=by_line)

    monkeypatch.setattr(files.readers, "threat_events", watched)
    rows = files.group_events(spark, str(tmp_path / "sf")).collect()
    first = [x for x in lines if x["part"] == 0]
    assert {x["component"] for x in first} == {x["component"] for x in lines} and len(first) == len({x["component"] for x in lines}) < len(lines)
    assert all(x["dest_ips"] or x["record_types"] for x in first) and not any({"dest_ips", "pids", "processes", "record_types"} & set(x) for x in lines if x["part"])
    assert all(x["corr_id"] and x["total_occurrences"] and 0 < len(x["events"]) <= 7 for x in lines)
    assert sum(r.n for r in rows) == sum(len(x["events"]) for x in lines) == sum(x["unique_events"] for x in first)


def test_documents_hold_no_groups_parts_at_once(spark, tmp_path, monkeypatch):
    groups = spark.sql("SELECT id AS component, concat('CG-', id) AS corr_id, 90L AS total_occurrences, array('a', 'b') AS dest_ips FROM range(3)")
    nested = spark.sql("SELECT id % 3 AS component, CAST(id DIV 3 AS INT) AS part, array(named_struct('first_us', id)) AS events FROM range(90)")
    join = writers.document_rows(groups, nested)._jdf.queryExecution().analyzed()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    # A key's rows are held of the side on the right.
    assert "part#" in join.children().apply(0).output().toString() and "dest_ips#" in join.children().apply(1).output().toString()
    sizes, kind = [], type(groups)
    write = kind.write.fget
    monkeypatch.setattr(kind, "write", property(lambda df: sizes.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) or write(df)))
    usual = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    writers.write_document(groups, str(tmp_path / "out"), spark.sql("SELECT 90 AS total_events"), nested)
    assert sizes == [usual, "64"] and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == usual
    found = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))["correlated_groups"]
    assert [(g["component"], g["part"], g.get("dest_ips"), g["total_occurrences"], g["events"]) for g in found] == [(c, p, None if p else ["a", "b"], 90, [{"first_us": 3 * p + c}]) for c in range(3) for p in range(30)]
