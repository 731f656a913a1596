"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a run of characters has a node after each character and an edge
for each piece.  Forward filtering sums the weights of all paths to each node;
backward sampling starts at the last node and draws the edge that leads to it,
in proportion to the forward sum it starts from times its weight, and so on to
the first node.  Forward sums depend on the run alone: a worker keeps those of
the runs it has met as tables of cumulative edge weights, and draws for all runs
of many documents at once, an edge each per step, by one search in the tables.

Draws are a hash of the row's key, the run's place in the text and the step, so
a segmentation depends on key, seed, text and model and on nothing else.

A BPE model stores the order of its merges in place of probabilities; the weight
of a piece is 1 / (its order + OFFSET), to the power of ``alpha``, and the weight
of a path the product of its pieces'.  A character that no piece has is its
bytes, on every path; so is a space mark (U+2581) in a text, since the piece of
that name stands for a space.  Every text is decoded to what it was.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.pieces import SPACE, PieceModel, piece_model
from lodewatch.llm.textkernels import _power_tables, mix

#: Order at which weights begin to fall.
OFFSET = 100.0
#: Edges that a worker keeps; beyond, it starts anew. A matter of speed alone.
MEMORY = 3_000_000
#: Characters of text that are drawn for together, unless one text is longer; arrays take some hundred bytes for each.
CHUNK_CHARS = 250_000
#: Characters of new runs whose sums are made together, unless one run is longer. Sums of a run don't depend on the others.
FRESH_CHARS = 50_000
#: Rows of a batch that are Python objects at once.
ROWS = 500
#: Characters from which on a run's sums are made one by one and not beside other runs'.
LONG_RUN = 256
#: Bits of a share, and all of it; an edge of less than half of the smallest share is never drawn.
SHARE_BITS = 32
ONE = 1 << SHARE_BITS
#: Runs that are drawn for one by one once they alone are left.
FEW_RUNS = 8
#: From here on, units stand for single bytes.
BYTE_UNIT = 0x110000
MARK = ord(SPACE)


def _draws(x: np.ndarray) -> np.ndarray:
    """Whole numbers below ``ONE`` from hashes."""
    return (mix(x) >> np.uint64(64 - SHARE_BITS)).astype(np.int64)


def _cut(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have so many characters together at most, or of one longer text."""
    i, size = 0, 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > most:
            yield i, j
            i, size = j, 0
        size += len(text)
    if texts:
        yield i, len(texts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _point(c: np.ndarray) -> np.ndarray:
    """A random-looking odd value for each code point."""
    return mix(c.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


class Sampler:
    """Tables of edges by node: ``bound`` (node * ``ONE`` + share of the edges up to this one), ``back`` (nodes it goes back) and ``piece``.

    Shares are whole numbers of which ``ONE`` is all, each rounded by itself
    and added exactly, so they are the same whatever other runs are there.
    """

    def __init__(self, model: PieceModel, alpha: float) -> None:
        self.model = model
        first = min(model.ids.values(), default=0)
        # Every path covers the same characters, so a factor for each character changes nothing but keeps sums nearer 1.
        self.weight = {p: (8.0 ** len(p) / (i - first + OFFSET)) ** alpha for p, i in model.ids.items()}
        # Hashes of all pieces and of what only begins one (weight 0).
        begins = dict.fromkeys((p[:n] for p in self.weight for n in range(1, len(p))), 0.0) | self.weight
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in begins]
        up, _ = _power_tables(self.model.longest)
        hashes = np.array([mix((_point(c) * up[: len(c)]).sum(dtype=np.uint64, keepdims=True))[0] for c in points], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = np.array(list(begins.values()))[order]
        self.pieces = np.array([model.ids.get(p, -1) for p in begins], np.int32)[order]
        self.is_known = np.zeros(0x110000, bool)
        self.is_known[[ord(p) for p in model.ids if len(p) == 1]] = True
        self.byte_ids = np.array(model.byte_ids, np.int32)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.run_node, self.run_units = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.bound, self.back, self.piece = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.n_nodes = self.n_edges = 0

    def units(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs' units in turn, and how many each has: a code point, or ``BYTE_UNIT`` + b for a byte of one that no piece has."""
        whole = "".join(runs)
        point = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        unknown = np.flatnonzero(~self.is_known[point] & (point != 32) | (point == MARK))
        point[point == 32] = MARK
        if not len(unknown):
            return point, sizes
        data = [whole[i].encode() for i in unknown]
        more = np.array([len(d) for d in data])
        run = np.repeat(np.arange(len(runs)), sizes)
        times = np.ones(len(point), np.int64)
        times[unknown] = more
        out = np.repeat(point, times)
        at = np.repeat((np.cumsum(times) - times)[unknown], more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        out[at] = np.frombuffer(b"".join(data), np.uint8).astype(np.int64) + BYTE_UNIT
        np.add.at(sizes, run[unknown], more - 1)
        return out, sizes

    def lattice(self, unit: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges ordered by the unit they end with, then by the one they start with: end, length, weight, piece."""
        n = len(unit)
        up, down = _power_tables(max(n, self.model.longest))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_point(unit) * up[:n], out=prefix[1:])
        at = np.flatnonzero(unit >= BYTE_UNIT)
        parts = [(at, np.ones(len(at), np.int64), np.ones(len(at)), self.byte_ids[unit[at] - BYTE_UNIT])]
        at, size = np.flatnonzero(unit < BYTE_UNIT), 1
        while len(at):
            key = mix((prefix[at + size] - prefix[at]) * down[at])
            where = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            begins = self.hashes[where] == key
            at, where = at[begins], where[begins]
            whole = self.weights[where] > 0
            parts.append((at[whole] + size - 1, np.full(whole.sum(), size), self.weights[where[whole]], self.pieces[where[whole]]))
            size += 1
            at = at[at + size <= stop[at]]
        end, length, weight, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(end * (self.model.longest + 1) - length)
        return end[order], length[order], weight[order], piece[order]

    def add(self, runs: list[str]) -> None:
        """Forward filtering of new runs: of all short ones at once, position by position; of each long one by itself."""
        unit, sizes = self.units(runs)
        start = np.cumsum(sizes) - sizes
        low = np.repeat(start, sizes)
        end, length, weight, piece = self.lattice(unit, low + np.repeat(sizes, sizes))
        long = np.repeat(sizes > LONG_RUN, sizes)[end]
        share = np.empty(len(end), np.int64)
        share[~long] = self._together(end[~long], length[~long], weight[~long], low, len(unit))
        for r in np.flatnonzero(sizes > LONG_RUN):
            i, j = np.searchsorted(end, [start[r], start[r] + sizes[r]])
            share[i:j] = self._alone(end[i:j] - start[r], length[i:j], weight[i:j])
        have, nodes, edges = len(self.known), self.n_nodes, self.n_edges
        for name, size, values in (("run_node", have, start + nodes), ("run_units", have, sizes), ("bound", edges, share + ((end + nodes) << SHARE_BITS)), ("back", edges, length), ("piece", edges, piece)):
            to = getattr(self, name)
            if size + len(values) > len(to):
                more = np.zeros(max(len(to) + len(to) // 4, size + len(values)), to.dtype)
                more[:size] = to[:size]
                setattr(self, name, to := more)
            to[size : size + len(values)] = values
        self.known.update(zip(runs, range(have, have + len(runs)), strict=True))
        self.n_nodes, self.n_edges = nodes + len(unit), edges + len(end)

    def _together(self, end: np.ndarray, length: np.ndarray, weight: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
        """The share of each node's sum that its edges up to each one make; sums of a position of all runs are made in one go."""
        place = end - low[end]
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(int(place.max()) + 2 if len(place) else 1))
        sums = np.ones(n + 1)  # the last one stands for the node before each run
        share = np.empty(len(end), np.int64)
        for j in range(len(cuts) - 1):
            e = order[cuts[j] : cuts[j + 1]]
            node = end[e]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            before = node - length[e]
            part = sums[np.where(before < low[node], -1, before)] * weight[e]
            total = np.add.reduceat(part, first)
            ends = node[first]
            sums[ends] = total
            count = np.diff(np.append(first, len(e)))
            whole = np.rint(part / np.repeat(total, count) * ONE).astype(np.int64)
            upto = np.cumsum(whole)
            upto -= np.repeat(upto[first] - whole[first], count)
            upto[np.append(first[1:], len(e)) - 1] = ONE
            share[e] = np.minimum(upto, ONE)
            if j >= 64:  # only ratios matter: the open sums of longer runs are scaled alike
                for back in range(min(j + 1, self.model.longest) - 1, -1, -1):
                    sums[ends - back] /= total
        return share

    def _alone(self, end: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The same for one run of any length; the sums that edges can still start from are kept, and scaled when they get small or large."""
        reach = self.model.longest + 1
        sums, share, made = [1.0], [], 0  # sums of the nodes from ``made`` on, the first one is before the run
        cuts = np.searchsorted(end, np.arange(int(end[-1]) + 2))
        sizes, weights = length.tolist(), weight.tolist()
        for node in range(len(cuts) - 1):
            parts = [sums[node + 1 - sizes[e] - made] * weights[e] for e in range(cuts[node], cuts[node + 1])]
            total = sum(parts)
            share += accumulate(round(x / total * ONE) for x in parts[:-1])
            share.append(ONE)
            sums.append(total)
            if len(sums) > 4096 or not 1e-100 < total < 1e100:
                made += max(len(sums) - reach, 0)
                sums = [s / total for s in sums[-reach:]]
        return np.minimum(np.array(share, np.int64), ONE)

    def _walk(self, low: int, node: int, key: np.uint64, t: int) -> list[int]:
        """The pieces of one long run from a node back to its first, by the draws from step ``t`` on."""
        bound = self.bound[: self.n_edges]
        i, j = np.searchsorted(bound, [low << SHARE_BITS, node << SHARE_BITS], side="right")
        at, back, piece = bound[i:j].tolist(), self.back[i:j].tolist(), self.piece[i:j].tolist()
        out: list[int] = []
        while node > low:
            for u in _draws(key + np.arange(t, t + 4096, dtype=np.uint64)).tolist():
                edge = min(bisect_right(at, ((node - 1) << SHARE_BITS) + u), len(at) - 1)
                out.append(piece[edge])
                node -= back[edge]
                if node <= low:
                    break
            t += 4096
        return out

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts in turn, and the n + 1 offsets of each text's."""
        if self.n_edges > MEMORY:
            self.reset()
        runs_of = [self.model.runs(t, marks_are_spaces=False) for t in texts]
        n_runs = np.array([len(r) for r in runs_of], np.int64)
        flat = [r for runs in runs_of for r in runs]
        known = self.known
        fresh = list(dict.fromkeys(r for r in flat if r not in known))
        for i, j in _cut(fresh, FRESH_CHARS):
            self.add(fresh[i:j])
        which = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), n_runs)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        key = mix(keys[doc] + mix(place.astype(np.uint64)))
        # By run, so that searches near each other in time are near in the tables.
        order = np.argsort(which, kind="stable")
        which, key = which[order], key[order]
        low = self.run_node[which]
        node = low + self.run_units[which]
        bound, back, piece = self.bound[: self.n_edges], self.back, self.piece
        steps = np.zeros(len(flat), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        active = np.arange(len(flat))
        t = 0
        while len(active) > FEW_RUNS or (len(active) and t < LONG_RUN):
            u = _draws(key[active] + np.uint64(t))
            edge = np.minimum(np.searchsorted(bound, ((node[active] - 1) << SHARE_BITS) + u, side="right"), self.n_edges - 1)
            drawn.append((active, piece[edge]))
            node[active] -= back[edge]
            steps[active] += 1
            active = active[node[active] > low[active]]
            t += 1
        alone = [self._walk(int(low[a]), int(node[a]), key[a], t) for a in active]
        steps[active] += np.array([len(p) for p in alone], np.int64)
        in_text = np.empty_like(steps)
        in_text[order] = steps
        end = np.cumsum(in_text)
        stop = end[order]
        out = np.empty(int(end[-1]) if len(end) else 0, np.int32)
        for t, (at, pieces) in enumerate(drawn):
            out[stop[at] - 1 - t] = pieces
        for a, pieces in zip(active, alone, strict=True):
            out[stop[a] - steps[a] : stop[a] - steps[a] + len(pieces)] = pieces[::-1]
        return out, np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n_runs)])]


_samplers: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, alpha: float) -> Sampler:
    if (path, alpha) not in _samplers:
        _samplers[path, alpha] = Sampler(piece_model(path), alpha)
    return _samplers[path, alpha]


def encode(df: DataFrame, model_path: str, alpha: float = 0.3, seed: int = 1, key_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ids``, a sampled segmentation of the text, to the key and the ``carry`` columns.

    Rows of the same key and text get the same segmentation, on any run and
    cluster; the key may be of any type that casts to a string, and may be
    null.  Null and empty texts have no pieces.  An empty table gives an empty
    table; columns not carried are ignored.  One narrow pass, nothing shuffled.
    A run of millions of characters without a space takes seconds a million
    and some hundred bytes a character.
    """
    row_key = F.xxhash64(F.lit(seed), F.col(key_col).cast("string"))
    own = df.select(F.col(key_col).alias("key"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), row_key.alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    head = own.drop("h", "text")
    names = [*head.columns, "ids"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = sampler(model_path, alpha)
        for batch in _slices(batches):
            keys = mix(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            texts = batch.column("text").to_pylist()
            for i, j in _cut(texts, CHUNK_CHARS):
                ids, offsets = draw.sample(texts[i:j], keys[i:j])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names[:-1]), lists], names=names)

    from pyspark.sql import types as T

    out = own.mapInArrow(each, T.StructType([*head.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(F.col("key").alias(key_col), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "ids")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text that the identifiers stand for; null identifiers give a null text.

    Whatever segmentation of a text is decoded, the text comes back.
    """
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name != to]
    schema = T.StructType([*kept, T.StructField(to, T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        table = model.byte_table()
        skip = 1 if model.prefix else 0
        for batch in _slices(batches):
            column = batch.column(ids_col)
            texts = [None if not x.is_valid else b"".join(map(table.__getitem__, x.values.to_numpy().tolist()))[skip:].decode("utf-8", "replace") for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), to])

    return df.mapInArrow(each, schema)
