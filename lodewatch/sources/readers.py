"""Readers of event files, sniffing of their formats, and normalizers to the unified event."""

from __future__ import annotations

import functools
import itertools
import json
import operator
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodewatch import schemas
from lodewatch.functions.text import parse_ts
from lodewatch.sources import splits

#: Characters of a file that show its format, and those of them, in texts up to closing braces, that may show its shape.
SNIFFED, SHOWN = 2000, 32_000


def _is_object(line: Column) -> Column:
    """The parser stops at the end of a first value; within brackets, what follows it shows."""
    alone = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    return line.startswith("{") & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()


def lines(spark: SparkSession, path: str, schema: StructType, source: str | None = None, files: Sequence[str] | None = None) -> DataFrame:
    """One JSON object a line; blank and malformed lines are skipped.

    Adds ``raw``, ``source_file`` (the file's whole path, or ``source`` for all
    files of a folder that is one source), and ``line``: the file and the
    line's number in it, the same for any splits and whatever other files are
    there.  ``files``: only these of the folder, as Spark names their paths.
    """
    rows = splits.numbered(splits.raw(spark, path, files))
    rows = rows.select(F.trim("value").alias("raw"), _source(source), F.concat_ws(":", splits.named(path, source), "number").alias("line"))
    return rows.where(_is_object(F.col("raw"))).withColumn("r", F.from_json("raw", schema)).select("raw", "source_file", "line", "r.*")


def _source(source: str | None) -> Column:
    return (F.lit(source) if source else F.col("path")).alias("source_file")


def objects(spark: SparkSession, path: str, schema: StructType, source: str | None = None, files: Sequence[str] | None = None) -> DataFrame:
    """Concatenated or pretty-printed JSON objects, of files of any size in any number of splits.

    Broken objects are skipped, but for whole ones inside them.  ``line`` is
    the file and the number of closing braces before the object, and its place
    among those of a broken one.
    """
    found = splits.objects(splits.raw(spark, path, files, "}"), splits.braces(spark, path, files))
    place = F.concat_ws(":", splits.named(path, source), "number", F.when(F.col("nth") > 0, F.col("nth")))
    found = found.select("raw", _source(source), place.alias("line"), F.from_json("raw", schema).alias("r"))
    return found.select("raw", "source_file", "line", "r.*")


#: S4, fixed values: what the first characters of a file of each format hold (one of them; of the first format, all), in this order.
MARKS = (
    ("applog", ('"script_content"', '"pattern_hits"')), ("legacy", ('"local_addr"', "etw_kernel_process")), ("process", ('"event_subtype"',)), ("network", ('"npcap_live"',)),
    ("file", ('"file_integrity"',)), ("usb", ('"USB_SESSION_END"',)), ("script", ('"detection"',)),
)


def kind_of(head: Column) -> Column:
    """The format that the first characters of a file show."""
    out = F.lit("unknown")
    for kind, marks in reversed(MARKS):
        shown = [head.contains(m) for m in marks]
        out = F.when(functools.reduce(operator.and_ if kind == "applog" else operator.or_, shown), kind).otherwise(out)
    return out


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``head`` of each file that has any text: its first texts up to closing braces; what is cut short is marked and shows no shape."""
    rows = splits.raw(spark, path, None, "}").where("split = 0")
    first = rows.groupBy("path").agg(F.min("place").alias("first"))
    text = F.concat(F.substring("value", 1, SNIFFED), F.when(F.length("value") > SNIFFED, "\x00").otherwise("}"))
    # A text has its brace at least, so that so many hold the characters.
    near = rows.join(first, "path").where(F.col("place") < F.col("first") + SNIFFED).select("path", F.struct((F.col("place") - F.col("first")).alias("i"), text.alias("t")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")
    return near.groupBy("path").agg(F.substring(joined, 1, SHOWN).alias("head"))


def inspected(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Of each file: ``input`` (the place of its path), ``path``, ``format``, and ``shape`` (lines or objects; null: not to be seen yet).

    A file is one of lines if its name or its folder's ends in ``.jsonl``, or
    if one of its lines is an object; application logs are read as objects
    otherwise, which their lines may be too.
    """
    heads = functools.reduce(DataFrame.unionByName, [_heads(spark, p).select(F.lit(i).alias("input"), "path", "head") for i, p in enumerate(paths)])
    kind = kind_of(F.substring("head", 1, SNIFFED))
    line = F.exists(F.split("head", "\n"), lambda x: _is_object(F.trim(x)))
    shape = F.when(F.col("path").rlike(r"\.jsonl(/[^/]*)?$"), "lines").when(kind == "applog", "objects").when(line, "lines")
    return heads.select("input", "path", kind.alias("format"), shape.alias("shape"))


def _with_lines(spark: SparkSession, path: str, files: Sequence[str]) -> set[str]:
    """Those of the files of which any line is an object."""
    found = splits.raw(spark, path, files).where(_is_object(F.trim("value"))).groupBy("path").count()
    return {r.path for r in found.collect()}


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """``source_file`` and ``format`` of each file of a folder that has any text."""
    return inspected(spark, [path]).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "format")


def _unified(df: DataFrame, ts: Column, **columns: Column) -> DataFrame:
    """All columns of the unified event; strings that aren't given are empty, the rest null, flags false."""
    out = {"event_id": F.sha2(F.concat_ws("\x00", "line", "raw"), 256), "source_file": F.col("source_file"), "ts": ts, "us": F.unix_micros(ts)} | columns
    if "host_id" in df.columns:
        out["host_id"] = F.col("host_id")
    empty = {"string": "", "boolean": None}
    picked = []
    for f in schemas.UNIFIED.fields:
        default = F.lit(False) if f.name in ("credential_access", "amsi_bypass", "process_injection") else F.lit(empty.get(f.dataType.simpleString()))
        value = out.get(f.name)
        if value is None:
            value = default
        elif f.dataType.simpleString() == "string":
            value = F.coalesce(value, F.lit(""))
        picked.append(value.cast(f.dataType).alias(f.name))
    return df.select(*picked)


def _same(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def normalize_legacy(df: DataFrame) -> DataFrame:
    """P1"""
    return _unified(df, parse_ts(F.col("ts")), record_type=F.coalesce("record_type", F.lit("unknown")), src_ip=F.col("local_addr"), dst_ip=F.col("remote_addr"), src_port=F.col("local_port"), dst_port=F.col("remote_port"),
                    **_same("source", "pid", "process_name", "canonical_path", "user_name", "user_sid", "protocol", "direction", "tcp_state", "ipv6", "signature_valid", "location_type", "new_child_flag", "persistence_touched"))


def normalize_network(df: DataFrame) -> DataFrame:
    """P2"""
    return _unified(df, parse_ts(F.col("ts")), source=F.coalesce("source", F.lit("npcap_live")), record_type=F.coalesce("record_type", F.lit("network_connect")), tcp_state=F.col("state"),
                    **_same("pid", "process_name", "canonical_path", "user_name", "user_sid", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "ipv6"))


def normalize_applog(df: DataFrame, strict: bool = False) -> DataFrame:
    """Script events of the shell; other sources keep their own name, unless ``strict``, which takes every row for one of the shell's."""
    shell = F.lit(True) if strict else F.col("source").startswith("PowerShell")
    return _unified(df, parse_ts(F.col("timestamp")), record_type=F.when(shell, "script_execution").otherwise(F.lower("source")), process_name=F.when(shell, "powershell.exe"), source=F.coalesce("source", F.lit("PowerShell")) if strict else F.col("source"), **_same("script_content", "pattern_hits", "credential_access", "amsi_bypass", "process_injection"))


def normalize_process(df: DataFrame) -> DataFrame:
    return _unified(df, parse_ts(F.col("ts")), source=F.lit("process"), record_type=F.coalesce("event_subtype", F.lit("process_start")),
                    **_same("pid", "process_name", "canonical_path", "user_name", "user_sid", "signature_valid", "location_type", "new_child_flag", "persistence_touched"))


def normalize_file(df: DataFrame) -> DataFrame:
    return _unified(df, parse_ts(F.col("timestamp")), source=F.col("endpoint"), record_type=F.concat(F.lit("file_"), "action"), pid=F.col("pid"), process_name=F.col("process"), canonical_path=F.lower("path"))


def normalize_script(df: DataFrame) -> DataFrame:
    return _unified(df, parse_ts(F.col("ts")), source=F.col("endpoint"), record_type=F.lit("script_execution"), pid=F.col("actor.pid"), user_name=F.col("actor.user"), process_name=F.col("details.app_name"), script_content=F.col("details.encoded_content"))


def normalize_usb(df: DataFrame) -> DataFrame:
    return _unified(df, parse_ts(F.col("timestamp")), source=F.col("endpoint"), record_type=F.lit("usb_session"), canonical_path=F.col("mount_point"))


@dataclass
class Normalizers:
    """Formats with their schema and normalizer; more can be registered."""

    known: dict[str, tuple[StructType, Callable[[DataFrame], DataFrame]]] = field(
        default_factory=lambda: {
            "legacy": (schemas.LEGACY, normalize_legacy), "network": (schemas.NETWORK, normalize_network), "applog": (schemas.APPLOG, normalize_applog), "process": (schemas.PROCESS, normalize_process),
            "file": (schemas.FILE, normalize_file), "script": (schemas.SCRIPT, normalize_script), "usb": (schemas.USB, normalize_usb),
        }
    )

    @classmethod
    def strict(cls) -> Normalizers:
        """Application logs of any source are script executions by the shell."""
        out = cls()
        out.register("applog", schemas.APPLOG, functools.partial(normalize_applog, strict=True))
        return out

    def register(self, name: str, schema: StructType, normalizer: Callable[[DataFrame], DataFrame]) -> None:
        self.known[name] = (schema, normalizer)

    def read(self, spark: SparkSession, path: str, kind: str | None = None, source: str | None = None) -> DataFrame:
        """S3: all files of a path, each in its own format and shape; an unknown format is read as network events.

        With a ``kind`` the format is not looked for, but the shape is.
        """
        return self.ingest(spark, {path: kind}, {path: source} if source else None)

    def ingest(self, spark: SparkSession, paths: dict[str, str | None] | Sequence[str], sources: dict[str, str] | None = None) -> DataFrame:
        """All inputs, {path: format or None} or paths alone, as one table of unified events; sources: names by path.

        All files are looked at in one job; what the driver takes is a row for
        each file, whose paths Spark's own index holds there anyway.  Files of a
        path that have one format and shape are one scan.
        """
        kinds = paths if isinstance(paths, dict) else dict.fromkeys(paths)
        names = list(kinds)
        groups: dict[tuple[int, str, str | None], list[str]] = defaultdict(list)
        for r in inspected(spark, names).collect():
            groups[r.input, kinds[names[r.input]] or r.format, r.shape].append(r.path)
        for i, kind, shape in list(groups):
            if shape is None:
                files = groups.pop((i, kind, shape))
                by_line = _with_lines(spark, names[i], files)
                for f in files:
                    groups[i, kind, "lines" if f in by_line else "objects"].append(f)
        alone = {i: sum(g[0] == i for g in groups) == 1 for i in range(len(names))}
        parts = []
        for (i, kind, shape), files in sorted(groups.items()):
            schema, normalize = self.known.get(kind, self.known["network"])
            scan = lines if shape == "lines" else objects
            parts.append(normalize(scan(spark, names[i], schema, (sources or {}).get(names[i]), None if alone[i] else files)))
        return functools.reduce(DataFrame.unionByName, parts or [spark.createDataFrame([], schemas.UNIFIED)])


def _events_of(found: object) -> Iterator[tuple[str | None, str | None, dict]]:
    if isinstance(found, dict) and isinstance(found.get("correlated_groups"), list):
        for g in found["correlated_groups"]:
            for e in g.get("events") or ():
                yield g.get("corr_id"), g.get("corr_type"), e
    elif isinstance(found, dict) and isinstance(found.get("events"), list):
        for e in found["events"]:
            yield found.get("corr_id"), found.get("corr_type"), e
    else:
        open_ = [found]
        while open_:
            x = open_.pop()
            if isinstance(x, dict):
                yield None, None, x
                x = list(x.values())
            if isinstance(x, list):
                open_.extend(reversed(x))


def threat_events(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Events of threat documents of any shape, with ``corr_id``, ``corr_type``, ``doc`` (the document) and ``pos`` (place in it).

    A document is correlated groups, a group or other object with ``events``,
    or anything nested, in which case each of its objects is an event.  A file
    is one document, or with ``by_line`` each of its lines is one, as
    ``writers.write_groups`` leaves them; texts that are no JSON are skipped.
    """
    if by_line:
        said = splits.numbered(splits.raw(spark, path)).select("value", F.concat_ws(":", "path", F.lpad(F.col("number").cast("string"), 20, "0")).alias("doc"))
    else:
        said = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("doc"))
    names = schemas.THREAT_EVENT.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, doc in zip(batch.column("value"), batch.column("doc").to_pylist(), strict=True):
                try:
                    found = _events_of(json.loads(text.as_py()))
                except ValueError:
                    continue
                n = 0
                while part := list(itertools.islice(found, 1000)):
                    text_of = lambda v: None if v is None or isinstance(v, dict | list) else v if isinstance(v, str) else json.dumps(v)
                    columns = [[text_of(e.get(k)) if isinstance(e, dict) else None for *_, e in part] for k in names]
                    yield pa.RecordBatch.from_arrays([pa.array([text_of(x[0]) for x in part], pa.string()), pa.array([text_of(x[1]) for x in part], pa.string()), pa.array([doc] * len(part)), pa.array(range(n, n + len(part)), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["corr_id", "corr_type", "doc", "pos", *names])
                    n += len(part)

    return said.mapInArrow(walk, "corr_id string, corr_type string, doc string, pos long, " + ", ".join(f"{n} string" for n in names))
