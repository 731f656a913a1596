"""Readers of folders: formats and shapes of each file, numbers of lines, objects over splits, torn files."""

import gzip
import json
import random

import pyarrow as pa
import pytest

from lodewatch import schemas
from lodewatch.sources import readers, splits


def network(i, **more):
    return {"ts": f"2026-01-05T10:00:01.{i:06d}Z", "source": "npcap_live", "record_type": "network_connect", "pid": i, "process_name": "t.exe", "src_ip": "10.0.0.5", "dst_ip": "8.8.8.8"} | more


@pytest.fixture
def small_splits(spark):
    """Splits of some kilobytes, so that small files are read by many tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_each_file_of_a_folder_in_its_own_format(spark, tmp_path):
    lines = lambda rows: "\n".join(json.dumps(r) for r in rows) + "\n"
    path = written(
        tmp_path, a__jsonl=lines(network(i) for i in range(50)), b__json="\n".join(json.dumps(network(100 + i), indent=2) for i in range(3)),
        c__jsonl=lines({"ts": "2026-01-05T10:00:01Z", "event_subtype": "process_start", "pid": i} for i in range(3)), d__json="", e__json=" \n \n",
        f__json="".join(json.dumps(network(200 + i, process_name='}{"')) for i in range(20)), g__log="no json\n" + "x" * 3000 + "\n" + lines(network(300 + i) for i in range(2)),
    )
    (tmp_path / "h [1] {x}.json").write_text(json.dumps([network(400), network(401)], indent=1))
    kinds = {r.source_file: r.format for r in readers.sniffed(spark, path).collect()}
    assert kinds["a.jsonl"] == kinds["b.json"] == kinds["f.json"] == "network" and kinds["c.jsonl"] == "process" and kinds["g.log"] == "unknown"
    events = readers.Normalizers().read(spark, path)
    got = sorted((r.record_type, r.pid) for r in events.collect())
    assert got == sorted([("process_start", i) for i in range(3)] + [("network_connect", i) for i in [*range(50), *range(100, 103), *range(200, 220), 300, 301, 400, 401]])
    assert events.select("event_id").distinct().count() == len(got)


def test_ids_are_of_path_and_line(spark, tmp_path, request):
    path = written(tmp_path, m__jsonl="\n".join(["", json.dumps(network(1)), json.dumps(network(1)), "{", *(json.dumps(network(i)) for i in range(2, 300))]), p__json="\n".join(json.dumps(network(1000 + i), indent=1) for i in range(100)))
    ids = lambda: {(r.pid, r.event_id) for r in readers.Normalizers().read(spark, path, source="s").where("pid < 2000").collect()}
    before = ids()
    assert len(before) == 400
    written(tmp_path, a__jsonl="\n".join(json.dumps(network(3000 + i)) for i in range(500)), z__json=json.dumps(network(4000)))
    assert ids() == before
    request.getfixturevalue("small_splits")
    assert readers.Normalizers().read(spark, path).rdd.getNumPartitions() > 30
    assert ids() == before
    lines = {r.pid: r.line for r in readers.lines(spark, f"{path}/m.jsonl", schemas.NETWORK).collect()}
    assert lines[2].endswith("m.jsonl:5") and lines[299].endswith("m.jsonl:302")


def test_one_long_line_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [network(i, process_name=random.Random(i).choice(["}", "{", '"}', "\\", "é}"]) * (i % 40)) for i in range(1500)]
    path = written(tmp_path, big__json="".join(json.dumps(r, ensure_ascii=False) for r in rows))
    found = readers.objects(spark, path, schemas.NETWORK)
    assert splits.raw(spark, path, None, "}").rdd.getNumPartitions() > 50
    assert sorted((r.pid, r.process_name) for r in found.collect()) == sorted((r["pid"], r["process_name"]) for r in rows)
    assert found.select("line").distinct().count() == 1500


def test_compressed_files_end_where_they_do(spark, tmp_path, small_splits):
    texts = ["{", "{\n", '{"pid": 1}', '{"pid": 2}\n', '{"pid": 3}\n{"pid": 4', '[{"pid": 5}, {"pid": 6}]', '"pid":7}', '{"pid": 8, "process_name": "}', "\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
        with gzip.open(tmp_path / f"{i}.json.gz", "wt") as f:
            f.write(text)
    found = sorted((r.source_file.split("/")[-1].removesuffix(".gz"), r.pid, r.source_file.endswith(".gz")) for r in readers.objects(spark, str(tmp_path), schemas.NETWORK).collect())
    plain, packed = ([x[:2] for x in found if x[2] == p] for p in (False, True))
    assert packed == plain and [pid for _, pid in plain] == [1, 2, 3, 5, 6]


def random_object(rng, depth=0):
    some = lambda: rng.choice([1, None, "x", "}{", "\\", '"', '{"q":1}', "a\nb", random_object(rng, depth + 1) if depth < 2 else 2, [random_object(rng, depth + 1)] if depth < 2 else 3])
    return {rng.choice(["a", "b{", "c}", 'd"', "e\\", "f\n"]): some() for _ in range(rng.randint(0, 4))}


def by_splits(text, rng, most):
    """What ``splits.objects`` does, with cuts anywhere between texts, without a session."""
    texts = text.split("}")
    if texts[-1] == "":
        texts.pop()
    at = sorted(rng.sample(range(1, len(texts)), min(rng.randint(0, most), len(texts) - 1))) if len(texts) > 1 else []
    parts = [(i * 1000, texts[x:y]) for i, (x, y) in enumerate(zip([0, *at], [*at, len(texts)], strict=True)) if x < y]
    if not parts:
        return []
    batch = lambda t, **more: pa.RecordBatch.from_pydict({k: [v] * len(t) for k, v in more.items()} | {"value": pa.array(t, pa.string())})
    seen = list(splits._summaries(batch(t, path="p", split=s, size=len(text.encode())) for s, t in parts))
    start = {r["split"]: r for r in splits._starts(pa.Table.from_batches(seen)).to_pylist()}
    cut = [r for s, t in parts for b in splits._cut(iter([batch(t, path="p", split=s, **{k: start[s][k] for k in ("before", "n", "inside", "depth", "closed")})])) for r in b.to_pylist()]
    whole = {r["number"]: r["text"] for r in cut if r["whole"]}
    last, open_ = None, {}
    for r in sorted((r for r in cut if not r["whole"]), key=lambda r: r["part"]):
        last = r["number"] if r["number"] is not None else last
        if last is not None:
            open_[last] = open_.get(last, "") + r["text"]
    assert not set(whole) & set(open_)
    return [json.loads(x) for _, t in sorted((whole | open_).items()) for x in splits.recovered(t)]


def test_objects_are_the_same_for_any_splits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [random_object(rng) for _ in range(rng.randint(0, 6))]
        text = rng.choice(["", "\n", " ", ",\n", "\n\n"]).join(json.dumps(r, indent=rng.choice([None, 2, 0]), ensure_ascii=rng.random() < 0.5) for r in rows) + rng.choice(["", "\n"])
        assert by_splits(f"[{text}]" if rng.random() < 0.2 else text, rng, 4) == rows


@pytest.mark.parametrize("torn", ["end", "beginning"])
def test_a_torn_line_costs_only_itself(torn):
    rng = random.Random(2)
    for _ in range(1000):
        rows = [random_object(rng) for _ in range(6)]
        said = [json.dumps(r) for r in rows]
        at = rng.randint(1, len(said[2]) - 1)
        said[2] = said[2][:at] if torn == "end" else said[2][at:]
        got = by_splits("\n".join(said) + "\n", rng, 4)
        assert all(rows[i] in got for i in (0, 1, 3, 4, 5))
