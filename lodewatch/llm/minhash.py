"""MinHash near-duplicate detection with sequential Bayesian verification.

Rows of equal word sequences are one class, so copies cost nothing more.  A
class goes by the number of one of its rows, not by an id, which rows of other
texts may have too; ids come in with the components at last.  Each class has a signature of min-wise hashes; bands of it name buckets, and the
classes of a bucket are candidates.  A candidate pair is compared a batch of
hashes at a time, and dropped once the posterior probability that it reaches
the threshold is under the chosen miss probability.  Survivors are verified on
their full shingle sets.

Candidates come in two rounds, after each of which components are known.  First
each class is compared with the pivot (smallest class) that it shares most
buckets with.  Then buckets that still hold several components are compared in
blocks of bounded size: signature against signature, survivors by the hashes of
their whole shingle sets, each pair in the first bucket that it shares.  A block
joins what is certainly similar as it goes and skips what is joined, so it gives
a link for each class at most, besides pairs that the hashes leave in doubt.
Every link is verified on the texts at last.

The classes of a bucket's largest component are compared with the others and
not with each other, so a group that is one component but for a few costs its
size.  A bucket with very many others is split first, by the rarest shingles of
its classes: with all shingles in one order, two sets of similarity t share one
of the first n - ceil(t * n) + 1 of each.  Texts of one template that differ
enough differ in these, so what they have in common brings them together no
more.  No candidate link between different components is left out, and no group
is spread into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.common import id_and_text, written
from lodewatch.operators.components import components
from lodewatch.llm.textkernels import Chunk, chunks, mix

#: Hashes compared between looks at the posterior.
BATCH = 32
#: Most hashes of a signature, and the chance that no band of a pair at the threshold agrees.
MOST_HASHES, BAND_MISS = 352, 1e-5
#: Chance to prune a pair at the threshold, at each look.
MISS = 1e-6

#: Columns that name a word sequence, and the seeds of their hashes.
FINGERPRINTS = (("f1", 1), ("f2", 2))
SIGNATURES = "id long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary"


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows with which the miss probability holds within the hashes allowed."""
    for rows in range(12, 0, -1):
        n = math.ceil(math.log(BAND_MISS) / math.log1p(-(threshold**rows)))
        if n * rows <= MOST_HASHES:
            return n, rows
    raise ValueError("the threshold is too low for the hashes allowed")


def least_matches(threshold: float, n: int, miss: float = MISS) -> int:
    """The fewest of n hashes that may agree: below, P(similarity >= threshold | matches) < miss.

    With a uniform prior the posterior is a beta distribution, and its tail is
    the chance of at most m successes in n + 1 trials of the threshold.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _shingles(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in turn, and where each document's begin."""
    key, at = chunk.grams(k)
    doc = chunk.doc[at] if len(at) else np.empty(0, np.int64)
    # A document of fewer words has its whole sequence as its one shingle.
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < k))
    if len(short):
        key, doc = np.concatenate([key, _sequences(chunk, 5)[short]]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(chunk.n_docs + 1))


def _sequences(chunk: Chunk, seed: int) -> np.ndarray:
    """A hash of each document's sequence of words."""
    place = np.arange(len(chunk.hash), dtype=np.int64) - chunk.first[chunk.doc] if len(chunk.hash) else np.empty(0, np.int64)
    each = mix(chunk.hash ^ mix(place.astype(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed)))
    total = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return mix(total[chunk.first[1:]] - total[chunk.first[:-1]] + np.uint64(seed))


def _signatures(chunk: Chunk, k: int, n_bands: int, rows: int) -> tuple[np.ndarray, ...]:
    key, first = _shingles(chunk, k)
    up, plus = _functions(n_bands * rows)
    half = (key >> np.uint64(32)).astype(np.uint32)
    least = np.full((chunk.n_docs, n_bands * rows), 0xFFFFFFFF, np.uint32)
    for d in range(chunk.n_docs):
        for i in range(first[d], first[d + 1], 256):
            part = half[i : min(i + 256, first[d + 1]), None] * up
            part += plus
            np.minimum(least[d], part.min(axis=0), out=least[d])
    by_band = least.reshape(chunk.n_docs, n_bands, rows).astype(np.uint64)
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    bands = mix((by_band * weights).sum(axis=2, dtype=np.uint64) + mix(np.arange(n_bands, dtype=np.uint64) + np.uint64(1000)))
    return np.diff(first), bands, least.astype(np.uint16)


def _pruned(threshold: float, n: int):
    looks = [(m, least_matches(threshold, m)) for m in range(BATCH, n + 1, BATCH)]

    @F.pandas_udf("boolean")
    def survives(a: pd.Series, b: pd.Series) -> pd.Series:
        alive = np.arange(len(a))
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b)) if len(a) else (np.empty((0, n)),) * 2
        matches = np.zeros(len(a), np.int64)
        for m, least in looks:
            matches[alive] += (x[alive, m - BATCH : m] == y[alive, m - BATCH : m]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pd.Series(out)

    return survives


def shingle_set(text: str, k: int) -> set:
    words = text.encode().lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _verified(k: int, percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            same = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, kept = a, shingle_set(x.as_py(), k)
                other = shingle_set(y.as_py(), k)
                both = len(kept & other)
                same.append(100 * both >= percent * (len(kept) + len(other) - both))
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return each


#: Classes of a bucket in a block, and those outside its largest component beyond which a bucket is split.
BLOCK, LARGE = 500, 5000
#: Share of a large bucket's classes that makes a shingle a frequent one, which comes after all others.
FREQUENT = 0.05
#: Shingles by which hashed sets may be off before a pair is in doubt. Of a million 64-bit hashes in a set, 3e-8 are expected to be equal.
DOUBT = 1
SPLIT = "sub long, bucket long, id long, n long, component long"
BODIES = "id long, text string, signature binary, bands binary, shingles binary"


def _with_shingles(k: int):
    """Adds the sorted hashes of each text's shingles; leaves out texts of an id that are not the class's own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, chunk in chunks(batch.column("text"), fold=True):
                key, first = _shingles(chunk, k)
                sets = [key[first[d] : first[d + 1]].tobytes() for d in range(j - i)]
                bands = [np.array(x.as_py(), np.int64).tobytes() for x in batch.column("bands").slice(i, j - i)]
                part = batch.slice(i, j - i)
                own = np.logical_and.reduce([_sequences(chunk, s).view(np.int64) == part.column(f).to_numpy() for f, s in FINGERPRINTS])
                full = pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), part.column("signature"), pa.array(bands, pa.binary()), pa.array(sets, pa.binary())], names=["id", "text", "signature", "bands", "shingles"])
                yield full.filter(pa.array(own))

    return each


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("shingles"), strict=True):
            found = np.frombuffer(body.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bucket)), pa.array(found)], names=["bucket", "s"])


def _first_shingles(percent: int):
    """Each class under each of its first shingles: rare ones by hash, then frequent ones, the rarest first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [batch.column(c).to_pylist() for c in ("bucket", "id", "n", "component")]
            for bucket, id_, n, component, body, often in zip(*others, batch.column("shingles"), batch.column("often"), strict=True):
                own = np.frombuffer(body.as_buffer(), np.int64)
                ranked = often.values.to_numpy() if often.is_valid else np.empty(0, np.int64)
                first = np.concatenate([own[~np.isin(own, ranked)], ranked[np.isin(ranked, own)]])[: n - -(-percent * n // 100) + 1]
                sub = mix(first.view(np.uint64) + mix(np.array([bucket], np.int64).view(np.uint64))).view(np.int64)
                same = lambda x: pa.array(np.full(len(sub), x, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(sub), same(bucket), same(id_), same(n), same(component)], names=["sub", "bucket", "id", "n", "component"])

    return each


def _mixed(labelled: DataFrame, key: str) -> DataFrame:
    """Buckets of several components: ``size``, the largest component (``main``) and its size (``most``)."""
    each = labelled.groupBy(key, "component").agg(F.count("*").alias("k"))
    found = each.groupBy(key).agg(F.sum("k").alias("size"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"))
    return found.where("size > most")


def _split(large: DataFrame, bodies: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Classes of large buckets, by the shingles that similar ones share."""
    sets = large.join(bodies.select("id", "shingles"), "id")
    counts = sets.select("bucket", "shingles").mapInArrow(_each_shingle, "bucket long, s long").groupBy("bucket", "s").agg(F.count("*").alias("times"))
    often = counts.join(sizes.select("bucket", "size"), "bucket").where(F.col("times") >= FREQUENT * F.col("size"))
    often = often.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("times", "s"))), lambda x: x["s"]).alias("often"))
    return sets.join(often, "bucket", "left").select("bucket", "id", "n", "component", "shingles", "often").mapInArrow(_first_shingles(percent), SPLIT)


def _compared(threshold: float, percent: int, n: int):
    """Links across components within a block, or between two blocks, of one bucket."""
    looks = [(m, least_matches(threshold, m)) for m in range(BATCH, n + 1, BATCH)]

    def compare(rows: pa.Table) -> pa.Table:
        bucket, p, q = (rows.column(c)[0].as_py() for c in ("bucket", "p", "q"))
        ids, size, root, block = (rows.column(c).to_numpy().copy() for c in ("id", "n", "component", "block"))
        matrix = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(len(ids), -1)
        x, bands = matrix("signature", np.uint16), matrix("bands", np.int64)
        raw: list[bytes | set] = rows.column("shingles").to_pylist()

        def shingles(i: int) -> set:
            if isinstance(raw[i], bytes):
                raw[i] = set(np.frombuffer(raw[i], np.uint64).tolist())
            return raw[i]

        a, b = [], []
        for i in range(len(ids)):
            other = np.arange(i + 1, len(ids)) if p == q else np.flatnonzero(block == q) if block[i] == p else np.empty(0, np.int64)
            other = other[(root[other] != root[i]) & (ids[other] != ids[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
            matches = np.zeros(len(other), np.int64)
            for m, least in looks:
                if not len(other):
                    break
                matches += (x[other, m - BATCH : m] == x[i, m - BATCH : m]).sum(axis=1)
                alive = matches >= least
                other, matches = other[alive], matches[alive]
            if not len(other):
                continue
            first = (bands[other] == bands[i]).argmax(axis=1)
            here = bands[i][first] == bucket
            for j in other[here][np.argsort(-matches[here], kind="stable")]:
                if root[i] == root[j]:
                    continue
                one, two = shingles(i), shingles(j)
                both = len(one & two)
                union = len(one) + len(two) - both
                if 100 * (both + DOUBT) < percent * (union - DOUBT):
                    continue
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
                if 100 * (both - DOUBT) >= percent * (union + DOUBT):
                    root[root == root[j]] = root[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def near_duplicates(df: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links rows whose sets of ``words``-word shingles have 100 * intersection >= percent * union.

    Letters A-Z are lower-cased; a text of fewer words has its whole sequence
    as its only shingle.  Returns, a row for each row: the id, ``n_shingles``,
    ``component_id`` (smallest id reachable by links) and ``kept`` (it is the
    row's own id).  Null and empty texts and texts without words have 0
    shingles and are linked with nothing.  Rows with a null id are linked with
    nothing, keep a null component and are kept.  Rows of one id are one node,
    with the links of all its texts.
    An empty table gives an empty table; other columns are ignored.
    """
    threshold = percent / 100
    n_bands, rows = bands_for(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, chunk in chunks(batch.column("text"), fold=True):
                n, bands, signature = _signatures(chunk, words, n_bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * n_bands + 1, n_bands, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
                bodies = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(0, (j - i + 1), dtype=np.int32) * np.int32(signature.shape[1] * 2)), pa.py_buffer(np.ascontiguousarray(signature))])
                f1, f2 = (pa.array(_sequences(chunk, s).view(np.int64)) for _, s in FINGERPRINTS)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n, pa.int64()), f1, f2, lists, bodies], names=["id", "n_shingles", "f1", "f2", "bands", "signature"])

    texts = id_and_text(df, id_col, text_col)
    signed = written(texts.mapInArrow(sign, SIGNATURES).withColumn("row", F.monotonically_increasing_id()), "signatures")
    linked = signed.where("n_shingles > 0 and id is not null")
    # By class: the smallest id, which is its node, and a row of that id, which stands for the class.
    classes = linked.groupBy("f1", "f2").agg(F.min(F.struct("id", "row")).alias("first"))
    classes = written(classes.select("f1", "f2", F.col("first.id").alias("node"), F.col("first.row").alias("class")), "classes")

    # Buckets of two classes or more; the pivot of a bucket is its smallest class.
    bodies = linked.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "bands")
    banded = bodies.join(classes.select(F.col("class").alias("id")), "id", "left_semi").select("id", "n", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("last")).where("pivot.id <> last").select("bucket", "pivot")
    shared = written(banded.join(pivots, "bucket").select("bucket", "id", "n", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "buckets")
    fits = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
    stars = shared.where((F.col("id") != F.col("pivot")) & fits("n", "pivot_n")).groupBy("pivot", "id").agg(F.count("*").alias("shares"))
    stars = written(stars.select(F.col("pivot").alias("a"), F.col("id").alias("b"), "shares"), "stars")

    needed = shared.select("id").distinct()
    heads = linked.select(F.col("id").alias("node"), F.col("row").alias("id"), "f1", "f2", "signature", "bands").join(needed, "id")
    nodes = needed.join(classes.select(F.col("class").alias("id"), "node"), "id").select("node").distinct()
    # Equal texts of one id would be one class's body twice.
    bodies = texts.withColumnRenamed("id", "node").join(nodes, "node", "left_semi").distinct().join(heads, "node")
    bodies = written(bodies.mapInArrow(_with_shingles(words), BODIES), "bodies")
    survives = _pruned(threshold, n_bands * rows)

    def verify(pairs: DataFrame, pruned: bool) -> DataFrame:
        pairs = pairs.select("a", "b").distinct()
        if not pruned:
            for side in ("a", "b"):
                pairs = pairs.join(bodies.select(F.col("id").alias(side), F.col("signature").alias(f"s_{side}")), side)
            pairs = written(pairs.where(survives("s_a", "s_b")).select("a", "b"), "survivors")
        for side in ("b", "a"):
            pairs = pairs.join(bodies.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
        return written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verified(words, percent), "a long, b long"), "links")

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shares", -F.col("a"))).alias("a"))
    links = verify(best, False)
    found = components(links)
    labelled = shared.select("bucket", "id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = written(_mixed(labelled, "bucket"), "sizes")
    open_ = written(labelled.join(sizes, "bucket").select(F.col("bucket").alias("sub"), "bucket", "id", "n", "component", "size", "most", "main"), "open")
    others = F.col("size") - F.col("most")
    large = open_.where(others > LARGE)
    if not large.isEmpty():
        parts = written(_split(large.select("bucket", "id", "n", "component"), bodies, sizes, percent), "parts")
        parts = parts.join(_mixed(parts, "sub"), "sub").select(*open_.columns)
        open_ = open_.where(others <= LARGE).unionByName(parts)
    # Blocks of the other classes come first, then those of the largest component; a class goes to each pair of blocks that its own is in.
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    is_main = F.col("component") == F.col("main")
    open_ = open_.withColumns({"first": count(others), "last": count(F.col("most"))})
    own = F.when(is_main, F.col("first") + F.pmod(F.xxhash64("id"), "last")).otherwise(F.pmod(F.xxhash64("id"), "first")).cast("int")
    open_ = open_.withColumns({"block": own, "with": F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("first")).otherwise(F.col("first") + F.col("last")) - 1))})
    open_ = open_.select("sub", "bucket", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "id", "n", "component", "block")
    open_ = open_.join(bodies.select("id", "signature", "bands", "shingles"), "id")
    pairs = written(open_.groupBy("sub", "p", "q").applyInArrow(_compared(threshold, percent, n_bands * rows), "a long, b long").distinct(), "pairs")
    if not pairs.isEmpty():
        links = links.unionByName(verify(pairs, True))

    # From classes to ids: an id links the classes that it has rows of.
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("class").alias(side), F.col("node").alias(f"n_{side}")), side)
    links = links.select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    sequence = F.struct("f1", "f2")
    several = linked.groupBy("id").agg(F.min(sequence).alias("x"), F.max(sequence).alias("y")).where("x <> y").select("id")
    of_ids = linked.select("id", "f1", "f2").join(several, "id").join(classes, ["f1", "f2"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = components(links.unionByName(of_ids))

    of_class = classes.join(found, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2"], "left")
    mine = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("id"), F.lit(True)).alias("kept"))
