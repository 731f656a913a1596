"""Hard negatives by exact integer inner products, found through an orthogonal rotation.

Every component x becomes the integer floor(scale * x), and scores are inner
products of these.  The rotation has the principal axes of the integer vectors,
from second moments summed over all rows; as it is orthogonal, products stay
what they are.  Anchors are compared with rows in blocks: products of leading
components are accumulated, what the other components can still add or take is
bounded by the product of the norms of the rests, with a slack for rounding,
and pairs that cannot count any more are discarded.  What survives is verified
by integer products, so the rotation decides the work and never the result.

Blocks of anchors (a stated set of queries) meet groups of blocks of rows, a
task each; a task keeps the best of each anchor only, and these are ranked once
more over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.llm.common import written

#: Bytes of integers in a block, and blocks of rows that a task takes for a block of anchors.
BLOCK_BYTES, GROUP = 1 << 20, 8
#: Pairs that are bounded at once, and the share of them below which the survivors are verified.
TILE, FEW = 1 << 20, 0.02
#: Shares of the components after which bounds are looked at.
LOOKS = (0.125, 0.25, 0.5, 1.0)
NONE = np.iinfo(np.int64).min
BODY = "ids binary, labels binary, q binary"


def _blocks(rows: DataFrame, dims: int, scale: int, name: str) -> DataFrame:
    """A table of blocks of rows: ids and labels (long), and their integers as 64-bit, row by row; short vectors end in zeros."""
    most = max(64, BLOCK_BYTES // (8 * max(dims, 1)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                own = batch.slice(i, most)
                vectors = own.column("vector")
                length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                if len(flat) and np.abs(flat).max() >= 2.0**31:
                    raise ValueError("a component is too large for integer products")
                q = np.zeros((own.num_rows, dims), np.int64)
                q[np.arange(dims) < length[:, None]] = flat.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{k}"]), *(pa.array([x], pa.binary()) for x in (own.column("id").to_numpy().tobytes(), own.column("label").to_numpy().tobytes(), q.tobytes()))], names=["block", "ids", "labels", "q"])
                k += 1

    return written(rows.mapInArrow(each, f"block string, {BODY}"), name)


def _rotation(blocks: DataFrame, dims: int) -> np.ndarray:
    """Principal axes of the integer vectors as columns, those of the largest second moments first."""
    if not dims:
        return np.eye(0)
    i, j = np.triu_indices(dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for body in batch.column("q"):
                q = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, dims).astype(np.float64)
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    # An entry for each pair of dimensions: what the driver takes follows the dimensions and not the rows.
    found = blocks.select("q").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    whole = np.zeros((dims, dims))
    for r in found:
        whole[r.i, r.j] = whole[r.j, r.i] = r.s
    return np.ascontiguousarray(np.linalg.eigh(whole)[1][:, ::-1])


class Side:
    """A block's ids, labels and integers, its rotated vectors, and the norms of their rests from each look on."""

    def __init__(self, ids: bytes, labels: bytes, q: bytes, rotation: np.ndarray) -> None:
        dims = len(rotation)
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.q = np.frombuffer(q, np.int64).reshape(len(self.ids), dims)
        whole = self.q.astype(np.float64) @ rotation
        self.y = whole.astype(np.float32)
        self.cuts = sorted({0, *(max(1, int(dims * x)) for x in LOOKS)}) if dims else [0]
        square = np.cumsum((whole**2)[:, ::-1], axis=1)[:, ::-1] if dims else np.zeros((len(self.ids), 0))
        self.rest = {c: np.sqrt(square[:, c]) if c < dims else np.zeros(len(self.ids)) for c in self.cuts}
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        self.most = int(np.abs(self.q).max()) if self.q.size else 0


def products(one: Side, two: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows i of one and j of two."""
    dims = one.q.shape[1]
    if one.most * two.most * max(dims, 1) >= 1 << 62:
        return np.array([sum(a * b for a, b in zip(one.q[x].tolist(), two.q[y].tolist(), strict=True)) for x, y in zip(i, j, strict=True)], np.int64)
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        out[k : k + (1 << 15)] = np.einsum("nd,nd->n", one.q[i[k : k + (1 << 15)]], two.q[j[k : k + (1 << 15)]])
    return out


def survivors(one: Side, two: Side, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``begin`` and on of one with all rows of two that may score from ``least`` to ``most`` (by row of one).

    The slack covers the rounding of rotated components to 24 bits and of
    their products and sums, for any order of summation.
    """
    own = slice(begin, begin + len(allowed))
    dims = one.q.shape[1]
    slack = ((2 * dims + 32) * 2.0**-23) * np.outer(one.norm[own], two.norm) + 1e-6
    partial = np.zeros(allowed.shape, np.float32)
    alive = allowed
    for low, high in zip(one.cuts, one.cuts[1:], strict=False):
        partial += one.y[own, low:high] @ two.y[:, low:high].T
        reach = np.outer(one.rest[high][own], two.rest[high]) + slack
        alive = alive & (partial + reach >= least[:, None]) & (partial - reach <= most[:, None])
        if alive.mean() < FEW:
            break
    i, j = np.nonzero(alive)
    return i + begin, j


class Best:
    """The best few (score, id) under each key: the highest scores, of equal ones the smallest ids."""

    def __init__(self, keys: int, few: int) -> None:
        self.few = few
        self.score, self.id = np.full((keys, few), NONE, np.int64), np.zeros((keys, few), np.int64)

    def floor(self) -> np.ndarray:
        """What a score must reach under each key to count; ties may count by their ids."""
        return self.score[:, -1].astype(np.float64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worth = score >= self.score[key, -1]
        key, score, ids = key[worth], score[worth], ids[worth]
        if not len(key):
            return
        touched = np.unique(key)
        old_key = np.repeat(touched, self.few)
        key, score, ids = np.concatenate([old_key, key]), np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -np.maximum(score, NONE + 1), key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = place < self.few
        self.score[key[kept], place[kept]] = score[kept]
        self.id[key[kept], place[kept]] = ids[kept]

    def rows(self) -> tuple[np.ndarray, ...]:
        """Key, place, score and id of all that is there."""
        key, place = np.nonzero(self.score != NONE)
        return key, place, self.score[key, place], self.id[key, place]


def _compared(anchors: DataFrame, blocks: DataFrame, groups: int, more: str | None, each: Callable[[pa.Table, Iterator[dict]], pa.Table], out: str) -> DataFrame:
    """``each`` over every block of anchors and every group of blocks of rows."""
    extra = [F.col(more)] if more else []
    numbered = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    names = anchors.select(F.col("block").alias("a"))
    rows = numbered.crossJoin(names).select("a", "g", F.lit(False).alias("query"), "ids", "labels", "q", *([F.lit(None).cast(anchors.schema[more].dataType).alias(more)] if more else []))
    asked = anchors.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("query"), "ids", "labels", "q", *extra)

    def task(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_pylist()
        at = is_query.index(True)
        others = (i for i, x in enumerate(is_query) if not x)
        row = lambda i: {c: table.column(c)[i].as_buffer() for c in ("ids", "labels", "q")}
        return each(table.slice(at, 1), map(row, others))

    return asked.unionByName(rows).groupBy("a", "g").applyInArrow(task, out)


def hard_negatives(
    df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """The first ``negatives`` rows of another label in each band of scores below an anchor's positives.

    A score is the integer inner product of two rows, whose components are
    floor(``scale`` * x); rows are ordered by score, highest first, then id.
    ``anchor``: a condition on the columns of ``df`` that picks the anchors.
    An anchor's positives are its first ``positives`` rows of the same label and
    another id (all, if fewer).  Negatives of a positive have another label and
    low * positive_score <= 100 * negative_score <= high * positive_score, so a
    positive of a negative score has none.  Returns anchor_id, positive_id,
    rank (int, from 1), negative_id, positive_score and negative_score.

    Rows with a null id, label or vector, or with any null or non-finite
    component, take no part.  Vectors of unlike lengths are compared as if the
    shorter ended in zeros; an empty one scores 0.  Repeated rows count as often
    as they are there; rows of an anchor's own id are never its partners.
    Integers of components from 2**31 on raise an error, as do scores beyond
    64 bits.  An empty table, or one without anchors, gives an empty table;
    other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"), finite.alias("finite"))
    known = known.where("id is not null and label is not null and vector is not null and finite").drop("finite")
    dims = known.agg(F.max(F.size("vector"))).first()[0] or 0
    blocks = _blocks(known.drop("anchor"), dims, scale, "rows")
    anchors = _blocks(known.where("anchor").drop("anchor"), dims, scale, "anchors")
    rotation = _rotation(blocks, dims)
    groups = max(1, -(-blocks.count() // GROUP))

    def side(body: dict) -> Side:
        return Side(body["ids"], body["labels"], body["q"], rotation)

    def first(table: pa.Table) -> Side:
        return side({c: table.column(c)[0].as_buffer() for c in ("ids", "labels", "q")})

    def tiles(one: Side, two: Side, same: bool, least: Callable[[], np.ndarray], most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, TILE // max(len(two.ids), 1))
        for begin in range(0, len(one.ids), step):
            own = slice(begin, begin + step)
            allowed = (one.labels[own, None] == two.labels) & (one.ids[own, None] != two.ids) if same else one.labels[own, None] != two.labels
            i, j = survivors(one, two, allowed, least()[own], most[own], begin)
            yield i, j, products(one, two, i, j)

    def find_positives(asked: pa.Table, others: Iterator[dict]) -> pa.Table:
        one = first(asked)
        best = Best(len(one.ids), positives)
        beyond = np.full(len(one.ids), np.inf)
        for two in map(side, others):
            for i, j, score in tiles(one, two, True, best.floor, beyond):
                best.add(i, score, two.ids[j])
        key, _, score, ids = best.rows()
        return pa.table([pa.array([asked.column("a")[0].as_py()] * len(key), pa.string()), pa.array(key), pa.array(ids), pa.array(score)], names=["a", "i", "positive_id", "positive_score"])

    found = _compared(anchors, blocks, groups, None, find_positives, "a string, i long, positive_id long, positive_score long")
    over = Window.partitionBy("a", "i").orderBy(F.desc("positive_score"), "positive_id")
    found = written(found.withColumn("k", F.row_number().over(over)).where(F.col("k") <= positives), "positives")
    # A list for each block of anchors, of at most so many positives for each of its rows.
    lists = found.groupBy("a").agg(F.collect_list(F.struct("i", "k", "positive_id", "positive_score")).alias("wanted")).withColumnRenamed("a", "block")
    wanted = anchors.join(lists, "block")

    def find_negatives(asked: pa.Table, others: Iterator[dict]) -> pa.Table:
        one = first(asked)
        listed = asked.column("wanted").combine_chunks().flatten()
        i, k, positive, score = (listed.field(n).to_numpy(zero_copy_only=False) for n in ("i", "k", "positive_id", "positive_score"))
        slot = i * positives + k - 1
        least = np.full(len(one.ids) * positives, np.iinfo(np.int64).max)
        most = np.full(len(one.ids) * positives, NONE)
        source = np.zeros((2, len(least)), np.int64)
        source[:, slot] = positive, score
        for s, p in zip(slot.tolist(), score.tolist(), strict=True):
            lo, hi = -(-low * p // 100), high * p // 100
            if lo <= hi:
                least[s], most[s] = lo, hi
        best = Best(len(least), negatives)
        top = most.astype(np.float64).reshape(-1, positives).max(axis=1)
        floor = lambda: np.maximum(least, best.floor()).reshape(-1, positives).min(axis=1)
        for two in map(side, others):
            for row, j, found_score in tiles(one, two, False, floor, top):
                for k in range(positives):
                    here = row * positives + k
                    fits = (found_score >= least[here]) & (found_score <= most[here])
                    best.add(here[fits], found_score[fits], two.ids[j[fits]])
        key, _, score, ids = best.rows()
        return pa.table(
            [pa.array([asked.column("a")[0].as_py()] * len(key), pa.string()), pa.array(key), pa.array(one.ids[key // positives]), pa.array(source[0, key]), pa.array(ids), pa.array(source[1, key]), pa.array(score)],
            names=["a", "slot", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    out = _compared(wanted, blocks, groups, "wanted", find_negatives, "a string, slot long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    over = Window.partitionBy("a", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = out.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
