"""Text files in splits: numbers of lines that no layout of splits changes, and JSON objects that go on over splits.

Spark cuts large files into byte ranges and gives each to a task; what a range
holds says nothing of where in the file it begins.  Counts of each split and
their prefix sums give its rows their numbers in the file.  For objects the same
is done with what a split does to a scanner: for each state that the scanner may be in
when it comes (outside or inside of a string), the state in which it leaves
and the function of depths, ``d -> max(d + a, b)``.  Such functions compose, so
the state at each split's start follows from the splits before, and all splits
are scanned at once.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits up to which their table, some 150 bytes for each, is sent to all executors; beyond, it is joined.
FEW_SPLITS = 200_000
#: The longest line that is read as a line; longer ones are no lines of a log, and are read as objects.
LONGEST_LINE = 256 << 20
#: Depths below any.
_NEVER = -(1 << 40)

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(//[^/]*)?"


def plain_path(path: Column) -> Column:
    """A path without its file system's name."""
    return F.regexp_replace(path, _SCHEME, "")


def named(root: str, source: str | None) -> Column:
    """What a file is called in ids: its whole path, or the source's name and the path within the source."""
    if not source:
        return F.col("path")
    top = re.sub(_SCHEME, "", root).rstrip("/")
    inner = plain_path(F.col("path"))
    return F.concat(F.lit(source), F.when(inner.startswith(top), F.substring(inner, len(top) + 1, 1 << 20)).otherwise(inner))


def raw(spark: SparkSession, path: str, files: Sequence[str] | None = None, separator: str | None = None) -> DataFrame:
    """Rows of text as they are: ``path``, ``size`` of the file, ``split`` (where it begins), ``place`` (rising within a split) and ``value``."""
    reader = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_LINE)
    found = (reader.option("lineSep", separator) if separator else reader).text(path)
    if files is not None:
        found = found.where(F.col("_metadata.file_path").isin(list(files)))
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a path, as they lie there."""
    return int(spark.read.text(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _small(rows: DataFrame) -> bool:
    """Whether the splits of the files together are few, by their sizes."""
    conf = rows.sparkSession._jsparkSession.sessionState().conf()
    total = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), total // cores)))
    return total // most + len(rows.inputFiles()) <= FEW_SPLITS


def _with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(splits) if _small(rows) else splits, ["path", "split"])


def numbered(rows: DataFrame) -> DataFrame:
    """``raw`` rows with their ``number`` in their file, from 1: the same for any sizes of splits, whatever other files are there."""
    splits = rows.groupBy("path", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _with_splits(rows, splits.select("path", "split", "first", before.alias("before"))).withColumn("number", F.col("before") + F.col("place") - F.col("first") + 1).drop("first", "before")


# --- Objects: rows are texts up to each closing brace.

_ESCAPE = re.compile(r"\\[^\n]")
Effect = tuple[bool, int, int]


def effect(text: str, inside: bool, closed: bool = True) -> tuple[bool, int, int, int]:
    """What a text and the brace that ends it do: whether a string is open at its end, (a, b) of depths, and the place of its first brace or -1.

    A string ends at a line end at the latest, as JSON has none in strings.  A
    text that begins with a brace after the brace before it, without a comma,
    begins an object of its own, whatever is still open.
    """
    parts = (_ESCAPE.sub("xx", text) if "\\" in text else text).split('"')
    begins = not inside and parts[0].lstrip().startswith("{")
    if any("\n" in p for p in parts[1 - inside :: 2]):
        # A torn string: line by line.
        opened, at, first, now = 0, 0, -1, inside
        for line in _ESCAPE.sub("xx", text).split("\n"):
            pieces = line.split('"')
            where = at
            for i, piece in enumerate(pieces):
                if (i % 2 == 0) != now:
                    opened += piece.count("{")
                    if first < 0 and "{" in piece:
                        first = where + piece.index("{")
                where += len(piece) + 1
            now_at_end = now ^ (len(pieces) % 2 == 0)
            at += len(line) + 1
            now = False
        now = now_at_end
    else:
        outside = parts[inside::2]
        opened = sum(p.count("{") for p in outside)
        now = inside ^ (len(parts) % 2 == 0)
        first = -1
        if opened:
            at = 0
            for i, p in enumerate(parts):
                if (i % 2 == 1) == inside and "{" in p:
                    first = at + p.index("{")
                    break
                at += len(p) + 1
    a, b = (_NEVER, 0) if begins else (0, 0)
    a, b = a + opened, b + opened
    if not now and closed:
        a, b = a - 1, max(b - 1, 0)
    return now, a, b, first


def then(one: Effect, two: tuple[Effect, Effect]) -> Effect:
    """One, and what follows it, which depends on whether one leaves a string open."""
    inside, a, b = two[one[0]]
    return inside, max(one[1] + a, _NEVER), max(one[2] + a, b)


_SPLIT = "path string, split long, size long, n long, bytes long, ends boolean, s0 boolean, a0 long, b0 long, s1 boolean, a1 long, b1 long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its texts, their bytes, and its effects from outside and from inside of a string."""
    last, row = None, []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, *row[:3], *row[3], *row[4])], names=[f.split()[0] for f in _SPLIT.split(", ")])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("path", "split", "size")), strict=True)
        for key, value in zip(keys, batch.column("value"), strict=True):
            if key != last:
                if last is not None:
                    yield done()
                last, row = key, [0, 0, False, (False, 0, 0), (True, 0, 0)]
            text = value.as_py()
            each = effect(text, False)[:3], effect(text, True)[:3]
            row = [row[0] + 1, row[1] + value.as_buffer().size, bool(text.strip()), then(row[3], each), then(row[4], each)]
    if last is not None:
        yield done()


def _starts(splits: pa.Table) -> pa.Table:
    """The state in which each split of a file is come to: texts before, in a string, depth; and for the last one whether its last text has its brace."""
    rows = sorted(splits.to_pylist(), key=lambda r: r["split"])
    spare = sum(r["n"] + r["bytes"] for r in rows) - rows[0]["size"]
    braces = rows[0].get("braces")
    # Of a compressed file its braces tell, of others the bytes, but for files that end elsewhere than their size says.
    closed = braces == sum(r["n"] for r in rows) if braces is not None else spare == 0 if spare in (0, 1) else rows[-1]["ends"]
    out, before, inside, depth = [], 0, False, 0
    for r in rows:
        out.append({"path": r["path"], "split": r["split"], "before": before, "n": r["n"], "inside": inside, "depth": depth, "closed": closed or r is not rows[-1]})
        before += r["n"]
        inside, a, b = [r[f"{x}{int(inside)}"] for x in "sab"]
        depth = max(depth + a, b)
    return pa.Table.from_pylist(out, pa.schema([("path", pa.string()), ("split", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("closed", pa.bool_())]))


def recovered(text: str) -> Iterator[str]:
    """The text, if it is an object; else each whole object in it, as a scan from each brace finds them."""
    try:
        if isinstance(json.loads(text), dict):
            yield text
        return
    except ValueError:
        pass
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            yield text[at:end]
        at = text.find("{", end)


_FOUND = "path string, number long, part long, text string, whole boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects that a split holds, and parts of those that go on over its ends (``number`` null: begun before)."""
    last, start, held, out = None, None, [], []

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["path", "number", "part", "text", "whole"])

    for batch in batches:
        names = ("path", "split", "before", "n", "inside", "depth", "closed")
        for row, text in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), batch.column("value").to_pylist(), strict=True):
            path, split, before, n, inside_, depth_, closed = row
            if (path, split) != last:
                if held:
                    out.append((last[0], start, part, "".join(held), False))
                last, i, inside, depth, held = (path, split), 0, inside_, depth_, []
                begun, start, part = depth > 0, None, before
            ends = closed or i < n - 1
            now, a, b, first = effect(text, inside, ends)
            begins = first >= 0 and a <= _NEVER // 2
            if (begins or depth == 0) and held:
                # Broken: another object begins before this one has ended.
                out.append((path, start, part, "".join(held), not begun))
                held, begun = [], False
            if begins or depth == 0:
                begun = False
                if first >= 0:
                    start, part, held = before + i + 1, before + i, [text[first:] + "}" * ends]
            else:
                held.append(text + "}" * ends)
            inside, depth = now, max(depth + a, b)
            if depth == 0 and held:
                out.append((path, start, part, "".join(held), not begun))
                held, begun, start = [], False, None
            i += 1
            if len(out) >= 1000:
                yield flush(out)
                out = []
    if held:
        out.append((last[0], start, part, "".join(held), False))
    if out:
        yield flush(out)


def _each_object(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = ((path, number, raw) for path, number, text in zip(*(batch.column(c).to_pylist() for c in ("path", "number", "text")), strict=True) for raw in recovered(text))
        seen: dict[tuple, int] = {}
        while part := list(itertools.islice(rows, 1000)):
            nth = []
            for path, number, _ in part:
                nth.append(seen.get((path, number), 0))
                seen[path, number] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([p[1] for p in part], pa.int64()), pa.array(nth, pa.int64()), pa.array([p[2] for p in part])], names=["path", "number", "nth", "raw"])


#: Names of files that Spark unpacks as it reads, whose sizes say nothing of their texts.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def braces(spark: SparkSession, path: str, files: Sequence[str] | None = None) -> DataFrame | None:
    """``path`` and ``braces``, how many closing ones it has, of each compressed file; none if there is no such file."""
    rows = raw(spark, path, files, "{").where(F.col("path").rlike(PACKED))
    if not any(re.search(PACKED, f) for f in rows.inputFiles()):
        return None
    return rows.groupBy("path").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit("}"), F.lit("")))).alias("braces"))


def objects(rows: DataFrame, braces: DataFrame | None = None) -> DataFrame:
    """JSON objects of ``raw`` rows that end at closing braces: ``path``, ``number`` (of the text in which it begins), ``nth`` and ``raw``.

    Files are cut into splits like any others.  Of what is broken, whole
    objects inside are given, told apart by ``nth``; the rest is skipped.
    ``braces``: as the function of that name counts them, which tells whether a compressed file ends with one.
    """
    own = rows.select("path", "split", "size", "value")
    splits = own.mapInArrow(_summaries, _SPLIT)
    if braces is not None:
        splits = splits.join(braces, "path", "left")
    starts = splits.groupBy("path").applyInArrow(_starts, "path string, split long, before long, n long, inside boolean, depth long, closed boolean")
    found = _with_splits(rows.select("path", "split", "value"), starts).mapInArrow(_cut, _FOUND)
    # Parts are two for each split at most, besides splits that lie within one object.
    over = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where("not whole").withColumn("number", F.last("number", True).over(over)).where("number is not null")
    joined = parts.groupBy("path", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    return found.where("whole").select("path", "number", "text").unionByName(joined).mapInArrow(_each_object, "path string, number long, nth long, raw string")
