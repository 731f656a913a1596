"""Patterns from a table of any size, looked for in texts by automata.

A part of the table, bounded in bytes, is one automaton that each worker builds
once; it finds all its patterns in one pass over a text, so that their number
costs next to nothing.  A larger table is more parts, and more passes, one
after the other: a worker holds one automaton.  Equal patterns are one in it,
with what counts of them together, so that a text's result is as small as what
is asked: a number, the best pattern, or else all ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.shared import discard, table_path, written

#: Bytes of patterns in a part, about; a part's patterns go through the driver, and an automaton takes some twenty times as much.
PART_BYTES = 4 << 20
#: Texts in a batch of results at most, and ids in its lists, about.
TEXTS, IDS = 1000, 1 << 20

#: Of the part that this worker searches: its automaton, the place of the empty pattern (or none), and the values.
_BUILT: dict[str, tuple[ahocorasick.Automaton | None, list[int], pa.Array]] = {}


def _built(shared) -> tuple[ahocorasick.Automaton | None, list[int], pa.Array]:
    name, words, values = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        find, empty = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for i, w in enumerate(words):
            if word := w.as_py():
                find.add_word(word, i)
            else:
                empty.append(i)
        if len(find):
            find.make_automaton()
        _BUILT[name] = find if len(find) else None, empty, values
    return _BUILT[name]


def _known(patterns: DataFrame, value: Column) -> DataFrame:
    """Distinct patterns in small letters with ``value``, an aggregate."""
    return patterns.where("pattern is not null").groupBy(F.lower("pattern").alias("pattern")).agg(value.alias("value"))


def _searched(df: DataFrame, known: DataFrame, text: Column, name: str, fold: Callable, size: Column, ordered: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds what ``fold`` makes of each text: of what earlier parts gave, the places of patterns found, and all values of the part.

    size: bytes of a row of ``known``.  ordered: values of a part come greatest first.
    keep: the columns of ``df`` that are needed after it (all unless given); a worker gets them with the text.
    """
    spark, before = df.sparkSession, None
    known = written(known, "patterns")
    parts = max(1, -(-(known.agg(F.sum(size)).first()[0] or 0) // PART_BYTES))
    out = df.withColumns({"text_": F.lower(text), name: F.lit(None).cast(known.schema["value"].dataType)})
    if keep is not None:
        out = out.select(*keep, "text_", name)
    for p in range(parts):
        part = known.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == p)
        part = (part.orderBy(F.desc("value")) if ordered else part).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *(pa.concat_arrays(part.column(c).chunks or [pa.array([], part.schema.field(c).type)]) for c in ("pattern", "value"))))
        more = p < parts - 1
        out = out.mapInArrow(_search(shared, name, fold, p > 0, more), (out if more else out.drop("text_")).schema)
        if more:
            # A pass is over before the next, else the workers of all would be there at once.
            path = table_path(spark, "searched")
            out = written(out, "searched", path)
            shared.destroy()
            if before:
                discard(spark, before)
            before = path
    return out


def _search(shared, name: str, fold: Callable, later: bool, more: bool) -> Callable:
    def results(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        find, empty, values = _built(shared)
        at, texts = batch.schema.get_field_index(name), batch.column("text_")
        begin, rows, ids = 0, [], 0
        for i in range(batch.num_rows):
            text, old = texts[i].as_py(), batch.column(at)[i] if later else None
            found = set() if text is None else {*empty, *(j for _, j in find.iter(text))} if find else set(empty)
            rows.append(fold(old, found, values))
            ids += len(rows[-1]) if isinstance(rows[-1], np.ndarray) else 0
            if i + 1 == batch.num_rows or len(rows) == TEXTS or ids > IDS:
                out = batch.slice(begin, len(rows))
                out = out.set_column(at, batch.schema.field(name), pa.array(rows, batch.schema.field(name).type))
                yield out if more else out.drop_columns(["text_"])
                begin, rows, ids = i + 1, [], 0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from results(batch)

    return each


def _all_ids(old: pa.Scalar | None, found: set[int], values: pa.Array) -> np.ndarray:
    lists = [np.asarray(values[i].values) for i in found]
    if old is not None and old.is_valid:
        lists.append(np.asarray(old.values))
    return np.concatenate(lists) if lists else np.zeros(0, np.int64)


def _sum(old: pa.Scalar | None, found: set[int], values: pa.Array) -> int:
    return sum(values[i].as_py() for i in found) + ((old.as_py() or 0) if old is not None else 0)


def _best(old: pa.Scalar | None, found: set[int], values: pa.Array) -> dict | None:
    options = [x for x in ([values[min(found)].as_py()] if found else []) + ([old.as_py()] if old is not None else []) if x is not None]
    return max(options, key=lambda x: [(v is not None, v) for v in x.values()], default=None) if len(options) > 1 else options[0] if options else None


def with_hits(df: DataFrame, patterns: DataFrame, text: Column, name: str = "hits") -> DataFrame:
    """Adds the ids of the patterns that occur in the text, ascending; capitals count as small letters.

    patterns: ``id`` (long) and ``pattern``.  The empty pattern is in every
    text, a null one in none; a null text holds no pattern.  Equal patterns
    may have many ids, all of which are given: for their number or the severest
    there is no need of them.
    """
    known = _known(patterns, F.collect_list(F.col("id").cast("long")))
    return _searched(df, known, text, name, _all_ids, F.octet_length("pattern") + 8 * F.size("value")).withColumn(name, F.array_sort(name))


def severest(df: DataFrame, patterns: DataFrame, text: Column, name: str = "match", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds a struct ``severity``, ``order`` and ``category``: the severest pattern in the text, of equals that of the smallest id; null without one.

    patterns: ``id``, ``pattern``, ``category``, ``severity`` (a number).  keep: the columns that stay, all unless given.
    """
    known = _known(patterns, F.max(F.struct(F.col("severity").cast("int").alias("severity"), (-F.col("id")).cast("long").alias("order"), "category")))
    size = F.octet_length("pattern") + F.coalesce(F.octet_length(F.col("value.category").cast("string")), F.lit(0)) + 16
    return _searched(df, known, text, name, _best, size, ordered=True, keep=keep)


def with_counts(df: DataFrame, patterns: DataFrame, text: Column, name: str = "pattern_hits", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds how many of the patterns (``id``, ``pattern``) occur in the text.  keep: the columns that stay, all unless given."""
    known = _known(patterns, F.count("*"))
    return _searched(df, known, text, name, _sum, F.octet_length("pattern") + 8, keep=keep).withColumn(name, F.col(name).cast("int"))
