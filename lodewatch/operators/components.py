"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodewatch.shared import discard, table_path, written

#: Links that one task takes whole, some megabytes; more are contracted in rounds over the cluster.
FEW = 200_000
#: Links for which the steps of a round are made in another slice of the nodes, and the most slices.
SLICE_LINKS, SLICES = 4_000_000, 8


@dataclass(frozen=True)
class Links:
    """Tables of links of one type, which are written one after the other, so that what the one shuffles is gone when the other does."""

    tables: list[DataFrame]

    @property
    def schema(self) -> StructType:
        return self.tables[0].schema


def _stars(links: DataFrame, path: str, large: bool, slices: int = 1) -> tuple[DataFrame, str]:
    """One step: the neighbours of a node are linked with the smallest of them and itself; in place of the links, which lie in ``path``.

    Least neighbours and links are written one after the other, and one slice of the nodes after the other, so that what
    the one shuffles is gone when the other does.  Slices may give the same link: the next step has a node's links in one slice.
    """
    spark, last = links.sparkSession, path
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    path = table_path(spark, "stars")
    for s in range(slices):
        aside = table_path(spark, "least")
        own = links.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == s) if slices > 1 else links
        least = own.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = written(least, "least", aside)
        joined = own.join(least, F.col("a") == F.col("u"))
        if large:
            # Equal links are one after the small step that follows.
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        out.write.mode("append").parquet(path)
        discard(spark, aside)
    discard(spark, last)
    return spark.read.schema(out.schema).parquet(path), path


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links at once: roots are hooked to smaller roots and paths halved until nothing changes."""
    parts = list(batches)
    if not sum(p.num_rows for p in parts):
        return
    links = pa.Table.from_batches(parts)
    names = pc.unique(pa.concat_arrays([c for n in ("a", "b") for c in links.column(n).chunks]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(links.column(n), names).to_numpy() for n in ("a", "b"))
    label = np.arange(len(names))
    while True:
        one, two = label[a], label[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["node", "component"])


def components(links: DataFrame | Links, few: int = FEW) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links ``a``, ``b``; ids of any type with an order.

    The links are written once.  Up to ``few`` of them are solved in one task,
    which their number bounds; beyond, each round of stars is written to the
    shared folder in place of the one before, and the rounds grow with the
    logarithm of the longest path.  Nodes without links don't appear.
    """
    tables = links.tables if isinstance(links, Links) else [links]
    spark = tables[0].sparkSession
    kind = links.schema["a"].dataType.simpleString()
    path = table_path(spark, "links")
    for x in tables:
        x.select("a", "b").where("a <> b").write.mode("append").parquet(path)
    links = spark.read.schema(f"a {kind}, b {kind}").parquet(path)
    n = links.count()
    if n <= few:
        return links.coalesce(1).mapInArrow(_whole, f"node {kind}, component {kind}")
    slices, seen = min(SLICES, 1 + n // SLICE_LINKS), None
    while True:
        for large in (True, False):
            links, path = _stars(links, path, large, slices)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    inner = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
