"""SimHash near-duplicate detection by bit-sliced comparison.

A fingerprint has 64 bits, one for each bit of its shingles' hashes: set where
more than half of the hashes have it.  Equal fingerprints are one, so copies of
a text cost nothing more.

Candidates come from the pigeonhole: cut into ``radius + e`` pieces, two
fingerprints within the radius are equal in ``e`` of them at least, so each
choice of ``e`` pieces is a table of buckets.  ``e`` grows with the number of
fingerprints, and so does the part of a choice that names the bucket, so that
buckets stay small; which links are found does not depend on it.

A bucket is compared in blocks of bounded size.  A block is kept vertically, a
word of 64 bits for 64 fingerprints in each of 64 planes.  A query's bit flips a
plane into that bit's differences, and carry-save adders count the differences
of all 64 at once; a word is abandoned when all its counts are beyond the
radius.  A task joins what it finds within its block as it goes, and gives a link
for each fingerprint at most, however many pairs are near.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.common import id_and_text, written
from lodewatch.operators.components import components

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Fingerprints in a bucket, about, and in a block of a bucket that has more.
BUCKET, BLOCK = 2048, 2048
#: Hashes of a text that are counted at once.
SLICE = 1 << 15
#: Queries at once against a block, and planes after which words are looked at.
QUERIES, LOOK = 512, 24

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8: 0 without words, and the whole sequence is the one shingle of fewer words."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    body = b" ".join(found)
    length = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(length + 1) - 1
    k = min(words, len(found))
    start, stop = (end - length)[: len(found) - k + 1], end[k - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), SLICE):
        hashes = np.array([digest(body[a:b], SEED) for a, b in zip(start[i : i + SLICE].tolist(), stop[i : i + SLICE].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def tables(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that name a bucket, a table each: pairs within the radius are equal under one mask at least."""
    bits = max(0, ceil(log2(max(n, 1) / BUCKET)))
    if not bits:
        return [0]
    for extra in range(1, BITS - radius):
        size = radius + extra
        cuts = [BITS * i // size for i in range(size + 1)]
        places = [range(cuts[i], cuts[i + 1]) for i in range(size)]
        chosen = [[b for i in c for b in places[i]] for c in combinations(range(size), extra)]
        if min(map(len, chosen)) >= bits or extra >= 6:
            return sorted({sum(1 << b for b in c[:bits]) for c in chosen})
    return [0]


def sliced(values: np.ndarray) -> np.ndarray:
    """Planes by bits: in word w of plane b, bit i is bit b of value 64 * w + i."""
    padded = np.zeros(-(-len(values) // 64) * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class Counter:
    """Counts of set bits by place, held as planes of ones, twos and fours; ``over`` marks those of eight or more."""

    def __init__(self, shape: tuple[int, ...]) -> None:
        self.ones, self.twos, self.fours, self.over = (np.zeros(shape, np.uint64) for _ in range(4))

    @staticmethod
    def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Full adder: carry and sum."""
        both = a ^ b
        return (a & b) | (both & c), both ^ c

    def eight(self, x: list[np.ndarray]) -> None:
        """Counts eight planes more."""
        add = self._add
        twos_a, self.ones = add(self.ones, x[0], x[1])
        twos_b, self.ones = add(self.ones, x[2], x[3])
        fours_a, self.twos = add(self.twos, twos_a, twos_b)
        twos_a, self.ones = add(self.ones, x[4], x[5])
        twos_b, self.ones = add(self.ones, x[6], x[7])
        fours_b, self.twos = add(self.twos, twos_a, twos_b)
        eights, self.fours = add(self.fours, fours_a, fours_b)
        self.over |= eights

    def within(self, radius: int) -> np.ndarray:
        """Marks the places whose count is at most the radius."""
        more, same = self.over.copy(), ~self.over
        for plane, weight in ((self.fours, 4), (self.twos, 2), (self.ones, 1)):
            if radius & weight:
                same &= plane
            else:
                more |= same & plane
                same &= ~plane
        return ~more

    def only(self, at: tuple[np.ndarray, ...] | np.ndarray) -> None:
        self.ones, self.twos, self.fours, self.over = (x[at] for x in (self.ones, self.twos, self.fours, self.over))


def near(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(query, value) of all pairs of a query and one of the n values of the planes that differ in at most ``radius`` bits.

    last: bits that are equal in most of them, and so are looked at last.
    """
    order = sorted(range(BITS), key=lambda b: (last >> b) & 1)
    flips = np.where(np.unpackbits(np.ascontiguousarray(queries, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), _ALL, _U(0))
    count = Counter((len(queries), planes.shape[1]))
    for i in range(0, LOOK, 8):
        count.eight([planes[b] ^ flips[:, b, None] for b in order[i : i + 8]])
    valid = np.full(planes.shape[1], _ALL)
    if n % 64:
        valid[-1] = _U((1 << n % 64) - 1)
    alive = count.within(radius) & valid
    query, word = np.nonzero(alive)
    count.only((query, word))
    for i in range(LOOK, BITS, 8):
        if not len(query):
            break
        count.eight([planes[b][word] ^ flips[query, b] for b in order[i : i + 8]])
        alive = count.within(radius) & valid[word]
        kept = np.flatnonzero(alive)
        query, word, alive = query[kept], word[kept], alive[kept]
        count.only(kept)
    if not len(query):
        return query, query
    row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(alive, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[row], word[row] * 64 + bit


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts a[i] and b[i] under one label, the smallest, for all i."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label[:] = label[label]


def _compared(radius: int):
    """Links within a block, or between two blocks, of one bucket: each fingerprint with the first that links lead to."""

    def compare(rows: pa.Table) -> pa.Table:
        p, q, mask = (rows.column(c)[0].as_py() for c in ("p", "q", "mask"))
        value = rows.column("fp").to_numpy()
        if p != q:
            block = rows.column("block").to_numpy()
            value = np.concatenate([value[block == p], value[block == q]])
            first = int((block == p).sum())
        fps = value.view(np.uint64)
        label = np.arange(len(fps))
        begin = 0 if p == q else first
        planes = sliced(fps[begin:])
        for i in range(0, len(fps) if p == q else first, QUERIES):
            queries = fps[i : min(i + QUERIES, len(fps) if p == q else first)]
            skip = i // 64 if p == q else 0
            x, y = near(queries, planes[:, skip:], len(fps) - begin - 64 * skip, radius, mask & 0xFFFFFFFFFFFFFFFF)
            _joined(label, x + i, y + begin + 64 * skip)
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table([pa.array(value[label[linked]]), pa.array(value[linked])], names=["a", "b"])

    return compare


def links_of(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` with the same components as all pairs of the distinct ``fp`` (long) within the radius."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold radii from 0 to 7")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [F.lit(signed(m)).cast("long") for m in tables(values.count(), radius)]
    keyed = values.select("fp", F.explode(F.array(*(F.struct(m.alias("mask"), m.bitwiseAND(F.col("fp")).alias("bucket")) for m in masks))).alias("t")).select("fp", "t.*")
    sizes = keyed.groupBy("mask", "bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    # A fingerprint goes to each pair of blocks that its own is in.
    own = keyed.join(sizes, ["mask", "bucket"]).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = own.select("mask", "bucket", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "fp", "block")
    return paired.groupBy("mask", "bucket", "p", "q").applyInArrow(_compared(radius), "a long, b long")


def simhash(df: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links rows whose SimHash fingerprints differ in at most ``radius`` bits.

    Letters A-Z are lower-cased; shingles are runs of ``words`` words, joined
    by a space, each as often as it is there.  Returns, a row for each row: the
    id, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest
    id reachable by links, itself included).  Null and empty texts and texts
    without words have the fingerprint 0, which is linked like any other.  Rows
    with a null id are linked with nothing and keep a null component.  Rows of
    one id are one node, with the links of all its texts.  A text is hashed
    whole, whatever its length.  An empty table gives an empty table; other
    columns are ignored.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column("text").cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    signed = written(id_and_text(df, id_col, text_col).mapInArrow(sign, "id long, fp long"), "fingerprints")
    known = signed.where("id is not null")
    # By fingerprint: its smallest id.
    classes = written(known.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    near_ = links_of(classes.select("fp"), radius)
    several = known.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id", "x")
    of_ids = known.join(several, "id").select(F.col("x").alias("a"), F.col("fp").alias("b"))
    found = written(components(near_.unionByName(of_ids)), "components")
    least = classes.join(found, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = classes.join(found, F.col("fp") == F.col("node"), "left").join(least, "component", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    out = signed.join(of_class, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
