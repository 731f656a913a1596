"""Writers: sparse JSON lines, logs of each endpoint, correlation and threat documents, alerts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodewatch.functions.tables import GENERIC_PROCESSES, SCRIPT_WINDOW, TIME_WINDOW
from lodewatch.operators.scan import running, total
from lodewatch.shared import few_at_once, written

# Fixed values. Names that script log rows carry.
SCRIPT_ENDPOINT, SCRIPT_SOURCE = "amsi_monitor", "AMSI-Buffer"


def sparse(df: DataFrame) -> Column:
    """The row as JSON without nulls, empty strings, false flags, zero ids and pattern hits."""
    fields = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if f.name == "pattern_hits":
            continue
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind == "boolean":
            c = F.when(c, c)
        elif f.name == "pid":
            c = F.when(c != 0, c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields))


def write_lines(df: DataFrame, path: str, per_file: int = 1_000_000, mode: str = "append", compression: str | None = None) -> None:
    """K2, K4, K6: JSON lines in files of at most so many records; ``mode`` overwrite starts the log anew."""
    df.select(sparse(df).alias("value")).write.mode(mode).option("maxRecordsPerFile", per_file).text(path, compression)


def with_severity(df: DataFrame, severity: Column) -> DataFrame:
    """K3: ``severity`` becomes the first field."""
    return df.select(severity.alias("severity"), *[c for c in df.columns if c != "severity"])


def script_log(events: DataFrame) -> DataFrame:
    """K5: rows of the script log: FULL with source and details, DEDUP (``is_dedup``) without.

    events: ``ts`` (text), ``severity``, ``lang``, ``detection``, ``hash``,
    ``app_name``, ``content_name``, ``content`` (binary), ``pid``, ``user``,
    ``is_dedup``.
    """
    full = ~F.col("is_dedup")
    details = F.struct("app_name", "content_name", F.base64("content").alias("encoded_content"))
    return events.select(
        "ts", F.when(full, "FULL").otherwise("DEDUP").alias("type"), F.lit(SCRIPT_ENDPOINT).alias("endpoint"), F.when(full, SCRIPT_SOURCE).alias("source"),
        "severity", "lang", "detection", "hash", F.when(full, details).alias("details"), F.struct("pid", "user").alias("actor"),
    )


def console_lines(decisions: DataFrame) -> DataFrame:
    """The rows that a console shows: all forwarded ones, and the first two and every tenth of those absorbed (``nth`` from 1)."""
    return decisions.where(F.col("forwarded") | (F.col("nth") <= 2) | (F.col("nth") % 10 == 0))


def in_lines(groups: DataFrame, nested: DataFrame, group: str = "component") -> DataFrame:
    """A row for each part of a group's events, with the group's columns.

    Its arrays have no bound, and are in its first part alone: in each they would grow with the square of a group.
    Groups are the side of the join whose rows of a key are held, as there is one; a group's parts may be most of the events.
    """
    own = [F.when(F.col("part") == 0, F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in groups.schema.fields]
    return nested.join(groups, group).select(*own, *(c for c in nested.columns if c != group))


def write_groups(groups: DataFrame, path: str, nested: DataFrame | None = None, group: str = "component", mode: str = "overwrite", compression: str | None = None, per_file: int = 20_000) -> None:
    """K1: correlated groups as JSON lines, partitioned by type, so many in a file at most; with ``nested``, a line for each part of a group's events (``in_lines``)."""
    out = groups if nested is None else in_lines(groups, nested, group)
    out.write.mode(mode).option("maxRecordsPerFile", per_file).partitionBy("corr_type").json(path, compression=compression)


def write_document(groups: DataFrame, path: str, meta_row: DataFrame, nested: DataFrame | None = None, group: str = "component") -> None:
    """K1: one JSON document ``{meta, correlated_groups}`` over the files of a folder, in the order of their names.

    The first line opens the document, each group (or part of one) is a line,
    the last line closes it; files are dealt by ranges in that order and
    committed by Spark, so a task that fails and runs again leaves nothing
    twice, and the document has any size.
    """
    write_document_rows(written(document_rows(groups, nested, group), "document"), path, meta_row, group)


def document_rows(groups: DataFrame, nested: DataFrame | None = None, group: str = "component") -> DataFrame:
    """The lines of a document between its ends, with what they are ordered by."""
    out = groups if nested is None else in_lines(groups, nested, group)
    return out.select(F.lit(1).alias("order_"), group, *([] if nested is None else ["part"]), F.to_json(F.struct(*out.columns)).alias("value"))


def write_document_rows(rows: DataFrame, path: str, meta_row: DataFrame, group: str = "component", compression: str | None = None) -> None:
    """``write_document`` for lines that are there already, as a table."""
    place = [c for c in ("order_", group, "part") if c in rows.columns]
    key = F.struct(*place[1:])
    first = rows.agg(F.min(key).alias("first_"))
    lines = rows.join(F.broadcast(first)).select(*place, F.concat(F.when(key == F.col("first_"), "").otherwise(","), "value").alias("value"))
    ends = meta_row.select(F.explode(F.array(F.struct(F.lit(0).alias("order_"), F.concat(F.lit('{"meta":'), F.to_json(F.struct(*meta_row.columns)), F.lit(',"correlated_groups":[')).alias("value")), F.struct(F.lit(2).alias("order_"), F.lit("]}").alias("value")))).alias("x")).select("x.*")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lines.unionByName(ends, allowMissingColumns=True).repartitionByRange(parts, *place).sortWithinPartitions(*place)
    with few_at_once(rows.sparkSession):
        whole.select("value").write.mode("overwrite").text(path, compression)


def write_rotated(df: DataFrame, path: str, most_bytes: int, order: Sequence[str], mode: str = "overwrite", fields: Sequence[str] | None = None) -> None:
    """K2: JSON lines of the fields (all columns, unless told) in the order of the columns, rotated by bytes: ``file=0`` and on, with one file in each.

    A file ends with the line that reaches the next multiple of the limit, so
    it is longer than the limit by less than a line.  Which file a line goes to
    follows from a running sum, so files are written by as many tasks.
    """
    lines = df.select(*order, sparse(df.select(*(fields or df.columns))).alias("value"))
    placed = running(lines, [], {"before_": total(F.octet_length("value") + 1, before=True)}, order)
    numbered = placed.withColumn("file", F.floor(F.col("before_") / most_bytes))
    numbered.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.mode(mode).partitionBy("file").text(path)


def meta(events: DataFrame, groups: DataFrame, version: str = "1") -> DataFrame:
    """K1: the one row that a correlation document begins with."""
    files = events.groupBy("source_file").agg(F.count("*").alias("n"))
    counted = files.agg(F.sum("n").alias("total_events"), F.array_sort(F.collect_list(F.element_at(F.split("source_file", "/"), -1))).alias("input_files"))
    config = F.struct(F.lit(TIME_WINDOW).alias("time_window_seconds"), F.lit(SCRIPT_WINDOW).alias("script_time_window_seconds"), F.array(*map(F.lit, sorted(GENERIC_PROCESSES))).alias("generic_names_excluded"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    total = groups.agg(F.count("*").alias("total_groups"))
    return counted.join(total).select(now.alias("generated_at"), F.lit(version).alias("correlator_version"), F.coalesce("total_events", F.lit(0)).alias("total_events"), "total_groups", "input_files", config.alias("config"))


def alerts(verdicts: DataFrame, nested: DataFrame, group: str = "component") -> DataFrame:
    """K8: a row for each judged group and part of its events: time, risk, verdict, events."""
    joined = verdicts.join(nested.select(group, "part", "events"), group, "left")
    return joined.select(F.coalesce(F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("UNKNOWN TIME")).alias("timestamp"), F.col("risk").alias("system_risk_level"), F.col("threat_level").alias("ai_evaluation"), F.coalesce("events", F.array().cast(_type(nested, "events"))).alias("raw_events"))


def _type(df: DataFrame, name: str):
    return df.schema[name].dataType


def _document(df: DataFrame) -> list:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()]


def threat_document(summary: DataFrame, results: DataFrame, nodes: DataFrame, edges: DataFrame) -> str:
    """K7: one JSON document of summary, results and graph; for results under a quota, as ``threat.capped`` leaves them."""
    return json.dumps({"summary": (_document(summary) or [{}])[0], "results": _document(results), "graph": {"nodes": _document(nodes), "edges": _document(edges)}}, indent=2)


def write_threats(path: str, summary: DataFrame, results: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
    """K7 for results of any size: JSON lines in a folder for each part."""
    for name, df in (("summary", summary), ("results", results), ("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{path}/{name}")
