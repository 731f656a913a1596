"""Streams over folders: bounded intake, timers, and whole runs over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodewatch.shared import table_path


def source(spark: SparkSession, path: str, schema: StructType, files: int | None = None, kind: str = "parquet") -> DataFrame:
    """A stream of a folder's files, at most so many in a micro-batch; nothing is dropped, the rest waits."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def every(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Appends the stream to a folder as JSON lines, at each interval, or once over what is there without one."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def whole(stream: DataFrame, name: str) -> DataFrame:
    """All rows of a stream over what is there now, once the last micro-batch is done."""
    spark = stream.sparkSession
    path = table_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
