"""Keys that earlier runs have seen, kept as a table, and a filter of bits before it.

The table is exact.  ``Filtered`` keeps bits of the keys beside it, made by
Spark's bitmap aggregates and merged by or, so that what a run asks of the table
is only the parts that hold keys whose bits are set; a key without its bit was
never seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def load(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The keys, as text; none if nothing was ever kept."""
    schema = StructType([StructField(k, StringType()) for k in keys])
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def keep(flagged: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the keys of novel events, as ``stateful.unseen`` flags them; a run adds each key once."""
    flagged.where("novel").select(*(flagged[k].cast("string").alias(k) for k in keys)).distinct().write.mode("append").parquet(path)


#: Bits of a filter (16 MB at most), bits in one of its rows, and parts of a kept table.
BITS, ROW_BITS, PARTS = 1 << 27, 32_768, 256


@dataclass(frozen=True)
class Filtered:
    """Kept keys under ``path``: ``keys``, a table in parts, and ``bits``, rows of bitmaps of each run."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def _hash(self) -> Column:
        """Of the keys as text, a missing one being unlike any other."""
        return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in self.keys))

    def _bit(self) -> Column:
        return F.pmod(self._hash(), F.lit(BITS))

    def _part(self) -> Column:
        return F.pmod(F.shiftright(self._hash(), 32), F.lit(PARTS)).cast("int")

    def _there(self, name: str) -> bool:
        to = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(to)

    def bits(self) -> DataFrame:
        """``row`` and ``bits`` of all runs together: at most BITS / ROW_BITS rows, whatever is kept."""
        found = self.spark.read.schema("row long, bits binary").parquet(f"{self.path}/bits")
        return found.groupBy("row").agg(F.bitmap_or_agg("bits").alias("bits"))

    def candidates(self, asked: DataFrame) -> DataFrame:
        """Distinct keys of ``asked`` whose bits are set, with their ``part``."""
        own = asked.select(*self.keys, self._bit().alias("bit_"), self._part().alias("part")).distinct()
        at = own.withColumns({"row": F.floor(F.col("bit_") / ROW_BITS), "in_row": (F.col("bit_") % ROW_BITS).cast("int")})
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("in_row") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), F.col("in_row") % 8 + 1)
        return at.join(self.bits(), "row").where(byte.bitwiseAND(mask) != 0).select(*self.keys, "part")

    def seen(self, asked: DataFrame) -> DataFrame:
        """The keys of ``asked`` that are kept, as text; of the table only the parts are read that candidates are in."""
        if not self._there("keys"):
            return load(self.spark, f"{self.path}/keys", self.keys)
        found = self.candidates(asked)
        parts = [r.part for r in found.select("part").distinct().collect()]
        kept = self.spark.read.schema(StructType([StructField(k, StringType()) for k in self.keys] + [StructField("part", StringType())])).parquet(f"{self.path}/keys")
        return kept.where(F.col("part").cast("int").isin(parts)).select(*self.keys)

    def keep(self, flagged: DataFrame) -> None:
        """Adds the keys of novel events, as ``stateful.unseen`` flags them, and their bits."""
        new = flagged.where("novel").select(*(F.col(k).cast("string").alias(k) for k in self.keys)).distinct()
        rows = new.select((F.floor(self._bit() / ROW_BITS)).alias("row"), (self._bit() % ROW_BITS).alias("at"))
        # The bits first: keys without them would be taken for novel, bits without keys only cost a look.
        rows.groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")).write.mode("append").parquet(f"{self.path}/bits")
        new.withColumn("part", self._part()).repartition("part").write.mode("append").partitionBy("part").parquet(f"{self.path}/keys")
