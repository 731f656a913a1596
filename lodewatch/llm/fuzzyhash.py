"""Context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever it has a certain value
modulo the block size, so pieces move with their content.  Each piece gives one
character of the signature, and a fingerprint has the signatures at a block
size and at twice that.  Fingerprints of compatible block sizes are compared by
edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.common import id_and_text, partitions
from lodewatch.llm.textkernels import _BYTE, _power_tables, mix

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
#: Bytes of the rolling hash; least block size; pieces that a signature has at most; pieces under which the block size is halved.
WINDOW, LEAST_BLOCK, MOST_PIECES, FEW_PIECES = 7, 3, 64, 32
#: Signatures with no common run of so many characters (or of the whole shorter one) are unlike.
COMMON = 4


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the size``, of the whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    up, down = _power_tables(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    begin = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    rolling = (mix((prefix[1:] - prefix[begin]) * down[begin]) >> np.uint64(32)).astype(np.uint32)
    block = LEAST_BLOCK
    while block * MOST_PIECES < n:
        block *= 2
    # Ends at a block size are ends at half of it, so the smallest in question has all.
    low = max(LEAST_BLOCK, block // 2)
    ends = np.flatnonzero(rolling % np.uint32(low) == low - 1)
    at = lambda size: ends[rolling[ends] % np.uint32(size) == size - 1]
    while len(found := at(block)) >= MOST_PIECES:
        block *= 2
    if len(found) + 1 < FEW_PIECES and block > low and len(half := at(block // 2)) < MOST_PIECES:
        block, found = block // 2, half
    return f"{block}:{_signature(prefix, down, found, n)}:{_signature(prefix, down, at(2 * block), n)}"


def _signature(prefix: np.ndarray, down: np.ndarray, ends: np.ndarray, n: int) -> str:
    stop = np.append(ends + 1, n) if not len(ends) or ends[-1] + 1 < n else ends + 1
    start = np.concatenate([[0], stop[:-1]])
    return _LETTERS[(mix((prefix[stop] - prefix[start]) * down[start]) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two strings, a column at a time in the bits of a number."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = mask, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        rise, fall = minus | ~(diagonal | plus) & mask, plus & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise = rise << 1 | 1
        plus, minus = (fall << 1 | ~(diagonal | rise)) & mask, rise & diagonal & mask
    return score


def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0
    k = min(COMMON, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(f: str, g: str) -> float:
    """1 for equal fingerprints, 0 for those of incompatible block sizes, else by the likest signatures of one block size."""
    if f == g:
        return 1.0
    (m, f1, f2), (n, g1, g2) = f.split(":"), g.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_like(f1, g1), _like(f2, g2)) if f1 and g1 else 0.0
    if m == 2 * n:
        return _like(f1, g2)
    if n == 2 * m:
        return _like(f2, g1)
    return 0.0


def with_next(df: DataFrame, each, schema: str) -> DataFrame:
    """Runs ``each`` on an iterator of (id, text, next text), by descending id; the first row is next to the last.

    Rows are dealt by ranges of ids, cut at ids that occur.  A row at a cut is
    sent to the range above it as well, and the rows of the largest id to the
    lowest range, so a range has all it needs: one shuffle, and one row is held
    at a time.
    """
    n = partitions(df.sparkSession)
    least = -(1 << 63)
    df = df.withColumn("order", F.coalesce("id", F.lit(least)))
    cuts, top = df.agg(F.percentile_approx("order", [k / n for k in range(1, n)] or [0.5], 100 * n), F.max("order")).first()
    splits = np.unique(np.array([c for c in (cuts or []) if c != top] if n > 1 else [], np.int64))

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        """Range doubled, and one more where the row is only to be next to another."""
        v = ids.to_numpy()
        own = np.searchsorted(splits, v)
        at_cut = (own < len(splits)) & (np.append(splits, 0)[own] == v) if len(splits) else np.zeros(len(v), bool)
        return pd.Series([[2 * int(b)] + [2 * int(b) + 3] * bool(c) + [1] * bool(t) for b, c, t in zip(own, at_cut, v == top, strict=True)])

    dealt = df.withColumn("target", F.explode(targets("order"))).withColumn("range", F.shiftright("target", 1))
    # In the lowest range the rows of the largest id come last.
    last = F.col("target") % 2
    dealt = dealt.repartitionById(len(splits) + 1, F.col("range")).sortWithinPartitions("range", last, F.col("order").desc(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def triples() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for doc, text, target in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("target").to_pylist(), strict=True):
                    text = text.as_py()
                    if held is not None:
                        yield *held, text
                    held = None if target % 2 else (doc, text)

        return each(triples())

    return dealt.select("id", "text", "target").mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """The last third of the text replaced by the first as many code points of another, or all that it has."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_batch: int = 2000) -> DataFrame:
    """Fingerprints every text, its edited text, and compares them with each other and with the next document's.

    Next is the row of the next smaller id, after the last the first.  Null and
    empty texts have the fingerprint of no pieces, which is like itself alone.
    A null id comes after all others; rows of one id follow each other in an
    order that depends on their texts only; a row that is alone is next to
    itself.  An empty table gives an empty table; other columns are ignored.
    """

    def each(triples: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        known: tuple[str, str] | None = None
        for doc, text, other in triples:
            own = known[1] if known and known[0] == text else fingerprint(text)
            known = (other, fingerprint(other))
            changed = edited(text, other)
            print_ = fingerprint(changed)
            rows.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, known[1])))
            if len(rows) >= rows_per_batch:
                yield batch()
                rows.clear()
        yield batch()

    out = with_next(id_and_text(df, id_col, text_col), each, SCHEMA)
    return out.withColumnRenamed("id", id_col)
