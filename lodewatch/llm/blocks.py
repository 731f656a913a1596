"""Whole documents in compressed blocks, and packed messages between blocks and buckets.

A block is some megabytes of consecutive rows, kept as one compressed Arrow
batch in a table in the shared folder, under a name that no later run changes.
What blocks ask of the whole corpus goes to buckets as packed arrays, one entry
for each distinct key of a block, so a key that a third of all documents hold
is one entry per block and not one per document.  The number of buckets grows
with the input and their size does not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.common import written

#: Bytes of text in a block, unless one document is longer.
BLOCK_BYTES = 2 << 20
#: Of zstd; a block is written once and shuffled twice.
LEVEL = 6
BLOCKS = "block string, n_rows long, n_bytes long, body binary"


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as source:
        return source.read_next_batch()


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most so many bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.array([0 if not x.is_valid else x.as_buffer().size for x in batch.column(text_at)], np.int64)
        begin = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                held.append(batch.slice(begin, i - begin))
                yield _joined(held)
                held, size, begin = [], 0, i
            size += int(n)
        if begin < len(lengths):
            held.append(batch.slice(begin))
    if held and size + sum(x.num_rows for x in held):
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def blocks_of(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str], name: str, most: int = BLOCK_BYTES) -> DataFrame:
    """A written table of blocks of ``df``: ids in column 0, texts in 1, carried columns from 2 on."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(_cut(batches, 1, most)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{k}"]), pa.array([rows.num_rows], pa.int64()), pa.array([sum(x.as_buffer().size for x in rows.column(1))], pa.int64()), pa.array([packed(rows)], pa.binary())],
                names=["block", "n_rows", "n_bytes", "body"],
            )

    return written(own.mapInArrow(each, BLOCKS), name)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the upper half of 64-bit keys; in the keys' order."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of runs of equal buckets."""
    if len(bucket):
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]]), strict=True):
            yield int(bucket[i]), int(i), int(j)
