"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the 7-word runs inside each window of 13 words,
the one of the smallest hash, the first of equals.  Two texts that share a
window share its anchor, at the same place in it.

1. Blocks send their distinct anchors to buckets, and learn which of them other
   documents hold (a false match of hashes here costs work, not results).
2. Documents are joined on these anchors: for each occurrence a block sends the
   stretch of words that the windows of this anchor cover, with the smallest id
   that has it.  In the bucket each stretch is extended from its anchor both
   ways, a word at a time as far as a window, against the stretches of earlier
   documents: windows are found by hash, and their words are compared.
3. Windows that repeat an earlier document grow together, within a stretch and
   over adjoining ones, to maximal repeats; they have the threshold's length at
   least, and their words are removed.

Every window belongs to one anchor's stretch, so it is judged once.  No pairs
of documents are made: a stretch is compared with the first document that has
its window.  A passage in any number of documents is one entry per block; where
there are many blocks, groups of them reduce their entries first, so that what a
bucket holds follows the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewatch.llm.blocks import BLOCK_BYTES, blocks_of, bucket_of, slices, unpacked
from lodewatch.llm.common import written
from lodewatch.llm.textkernels import Chunk, buffers, covered, mix, pieces

#: Distinct anchors in a bucket, about; the number of buckets follows from the bytes of text.
BUCKET_BYTES = 10 << 20
#: Blocks whose entries a bucket takes at once; more are reduced in groups first.
GROUP_BLOCKS = 1000
#: What a missing id counts as: later than any other.
LAST = np.iinfo(np.int64).max


#: Odd factors by place in a stretch, for two hashes of its windows.
_PLACES = [np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (5, 6)]


def _windows(chunk: Chunk, words: int, seed: int) -> tuple[np.ndarray, ...]:
    """Word at which each window starts, the hash of its anchor, the anchor's first word, and the window's own hash."""
    key, at = chunk.grams(words)
    if not len(at):
        return at, key, at, key
    gram, where = chunk.grams(seed)
    every = np.zeros(len(chunk.hash), np.uint64)
    every[where] = gram
    anchor, place = every[at], at.copy()
    for j in range(1, words - seed + 1):
        other = every[at + j]
        less = other < anchor
        anchor[less] = other[less]
        place[less] = at[less] + j
    return at, anchor, place, key


def _stretches(place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one anchor's occurrence in turn: the first of each stretch, and two hashes that name its words."""
    if not len(place):
        return place, key, key
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    nth = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    return begin, *(mix(np.add.reduceat(key * factors[nth], begin)) for factors in _PLACES)


class Words:
    """The words of a chunk with one space between those of a document, so that equal words are equal bytes."""

    def __init__(self, chunk: Chunk) -> None:
        keep = ~chunk.space
        after = chunk.end[chunk.end < len(chunk.data)]
        keep[after] = True
        data = np.where(chunk.space, np.uint8(32), chunk.data)[keep]
        self.text = data.tobytes()
        to = np.concatenate([[0], np.cumsum(keep)])
        self.start, self.end = to[chunk.start], to[chunk.end]


def _earlier(key: np.ndarray, own: np.ndarray, begin: np.ndarray, end: np.ndarray, text: bytes, next_to: np.ndarray) -> np.ndarray:
    """Which windows are in a document of a smaller id, by their words.

    key: hashes; own: ids; begin, end: bytes of each window in the text;
    next_to: whether a window is the one after the window before it.  Matches
    are extended over windows that follow each other on both sides, and the
    words of each whole match are compared; should words differ under one hash,
    its windows are told apart by words.
    """
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((own, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(key))))
    again = own > own[first]
    at = np.flatnonzero(again)
    if not len(at):
        return again
    to = first[at]
    cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1) | ~next_to[at[1:]] | ~next_to[to[1:]]])
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(at)) - 1
    spans = zip(begin[at[lo]].tolist(), end[at[hi]].tolist(), begin[to[lo]].tolist(), end[to[hi]].tolist(), strict=True)
    unlike = [i for i, (a, b, c, d) in enumerate(spans) if text[a:b] != text[c:d]]
    for i in unlike:
        for k in np.unique(key[at[lo[i] : hi[i] + 1]]):
            least: dict[bytes, int] = {}
            members = np.flatnonzero(key == k)
            for m in members:
                w = text[begin[m] : end[m]]
                least[w] = min(least.get(w, int(LAST)), int(own[m]))
            again[members] = [own[m] > least[text[begin[m] : end[m]]] for m in members]
    return again


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def _chunk(batch: pa.RecordBatch) -> Chunk:
    return Chunk(*buffers(batch.column(1)))


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _distinct_anchors(chunk: Chunk, at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's anchors in order, and which of them several of its documents have."""
    order = np.argsort(anchor, kind="stable")
    found = anchor[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    begin = np.flatnonzero(new)
    doc = chunk.doc[at[order]] if len(at) else np.empty(0, np.int64)
    stop = np.append(begin[1:], len(found)) - 1
    return found[begin], doc[begin] != doc[stop] if len(begin) else np.empty(0, bool)


MESSAGE = "block string, bucket int, h binary, x binary"


def _message(block: str, bucket: list[int], h: list[bytes], x: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(h), pa.string()), pa.array(bucket, pa.int32()), _binary(h), _binary(x)], names=["block", "bucket", "h", "x"])


def _messages(rows: list[tuple[str, int, bytes, bytes | None]]) -> pa.Table:
    block, bucket, h, x = ([r[i] for r in rows] for i in range(4))
    return pa.table([pa.array(block, pa.string()), pa.array(bucket, pa.int32()), _binary(h), _binary(x)], names=["block", "bucket", "h", "x"])


def _packed_ids(ids: np.ndarray) -> bytes:
    base = ids.min()
    if int(ids.max()) - int(base) < 1 << 32:
        return base.tobytes() + (ids - base).astype(np.uint32).tobytes()
    return base.tobytes() + ids.tobytes()


def _unpacked_ids(body: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(body, np.int64, 1)[0]
    if len(body) == 8 + 4 * n:
        return np.frombuffer(body, np.uint32, offset=8).astype(np.int64) + base
    return np.frombuffer(body, np.int64, offset=8)


def _counted(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The anchors of each row, which of all of them several documents have, and where rows end."""
    h = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("h")]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(k)).astype(bool) for x, k in zip(rows.column("x"), h, strict=True)]
    values, inverse, counts = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    again = counts > 1
    again[inverse[np.concatenate(several)]] = True
    return h, again[inverse], np.cumsum([len(k) for k in h])[:-1]


def _stretch_body(size: np.ndarray, texts: Iterable[bytes], ids: np.ndarray) -> bytes:
    return b"".join([size.astype(np.uint32).tobytes(), *texts, _packed_ids(ids)])


def _opened(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, bytes]:
    """The names of each row's stretches; the sizes, ids and words of all of them."""
    names = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("h")]
    sizes, bodies, ids = [np.empty(0, np.int64)], [], [np.empty(0, np.int64)]
    for v, k in zip(rows.column("x"), names, strict=True):
        body = v.as_buffer()
        size = np.frombuffer(body, np.uint32, len(k)).astype(np.int64)
        stop = 4 * len(k) + int(size.sum())
        sizes.append(size)
        bodies.append(body[4 * len(k) : stop])
        ids.append(_unpacked_ids(body[stop:].to_pybytes(), len(k)))
    return names, np.concatenate(sizes), np.concatenate(ids), b"".join(bodies)


def _marked(rows: pa.Table, names: list[np.ndarray], marks: np.ndarray) -> pa.Table:
    """To each row's block: its stretches with a repeated window, and the windows as bits."""
    each = np.split(marks.astype(np.uint16), np.cumsum([len(k) for k in names])[:-1])
    return _messages([(block, bucket, k[m > 0].tobytes(), m[m > 0].tobytes()) for block, bucket, k, m in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), names, each, strict=True) if m.any()])


def _told_apart(names: np.ndarray, size: np.ndarray, text: bytes) -> np.ndarray:
    """Names by which stretches of unlike words differ: the given ones, but for those whose words aren't those of the first of the name.

    The same rows in any order give the same names to the same words.
    """
    if not len(names):
        return names
    stop = np.cumsum(size)
    order = np.argsort(names, kind="stable")
    head = np.empty(len(names), np.int64)
    new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    head[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(names))))
    said = lambda i: text[stop[i] - size[i] : stop[i]]
    unlike = {int(names[i]) for i, h in enumerate(head.tolist()) if i != h and (size[i] != size[h] or said(i) != said(h))}
    if not unlike:
        return names
    out, taken = names.copy(), set(names.tolist())
    for name in sorted(unlike):
        members = np.flatnonzero(names == name).tolist()
        for words in sorted({said(i) for i in members})[1:]:
            other = name
            while other in taken:
                other = int(mix(np.array([other], np.uint64) + np.uint64(1))[0])
            taken.add(other)
            out[[i for i in members if said(i) == words]] = other
    return out


def _reduced(rows: pa.Table) -> pa.Table:
    """A group's stretches, each once, of the smallest id that has it; equal ones have equal words."""
    names, size, own, text = _opened(rows)
    of, stops = _told_apart(np.concatenate(names), size, text), np.cumsum(size)
    order = np.lexsort((own, of))
    keep = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
    cut = lambda i: text[stops[i] - size[i] : stops[i]]
    return _messages([(str(rows.column("part")[0].as_py()), rows.column("bucket")[0].as_py(), of[keep].tobytes(), _stretch_body(size[keep], map(cut, keep.tolist()), own[keep]))])


def _spread(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """To each of a group's blocks what the group was told of its stretches."""
    names, size, own, text = _opened(rows)
    if not names:
        return _messages([])
    known, marks = (np.concatenate([np.empty(0, kind), *(np.frombuffer(v.as_buffer(), kind) for v in answers.column(c))]) for c, kind in (("h", np.uint64), ("x", np.uint16)))
    values, inverse = np.unique(_told_apart(np.concatenate(names), size, text), return_inverse=True)
    least, told = np.full(len(values), LAST), np.zeros(len(values), np.uint16)
    np.minimum.at(least, inverse, own)
    told[np.searchsorted(values, known)] = marks
    # Whatever the group's first document with a stretch is told, all windows of the others repeat that one.
    return _marked(rows, names, np.where(own > least[inverse], np.uint16(0xFFFF), told[inverse]))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13, seed: int = 7, carry: Sequence[str] = (), verbatim: bool = False, block_bytes: int = BLOCK_BYTES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Removes each word that lies in a window of ``words`` words which also starts in a row of a smaller id.

    Returns the id, the ``carry`` columns, ``n_words``, ``n_removed``,
    ``kept_text`` (kept words joined by a space; with ``verbatim``, a text that
    loses none stays as it is) and ``repeats`` (start and
    length in words of each maximal run that was removed), a row for each row.
    Windows are judged on the input.  Null and empty texts have no words; texts
    under ``words`` words lose none.  A null id counts as later than any other.
    Rows of one id do not remove each other's words.  An empty table gives an
    empty table; columns not carried are ignored, and carried ones may have any
    name but those of the result.
    """
    taken = {id_col, "n_words", "n_removed", "kept_text", "repeats"} & set(carry)
    if taken:
        raise ValueError(f"the result has columns of these names: {sorted(taken)}")
    if not 1 <= seed <= words < seed + 16:
        raise ValueError("a window has at most 15 words more than its anchor")
    spark = df.sparkSession
    blocks = blocks_of(df, id_col, text_col, carry, "blocks", block_bytes)
    n_buckets = 1 + int(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block"), batch.column("body"), strict=True):
                chunk = _chunk(unpacked(body.as_py()))
                at, anchor, _, _ = _windows(chunk, words, seed)
                found, several = _distinct_anchors(chunk, at, anchor)
                rows = [(b, found[i:j].astype(np.uint32).tobytes(), np.packbits(several[i:j]).tobytes()) for b, i, j in slices(bucket_of(found, n_buckets))]
                yield _message(block.as_py(), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    def answer_anchors(rows: pa.Table) -> pa.Table:
        h, again, cuts = _counted(rows)
        out = [(block, bucket, k[m].tobytes()) for block, bucket, k, m in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), h, np.split(again, cuts), strict=True) if m.any()]
        return _messages([(block, bucket, k, None) for block, bucket, k in out])

    def reduce_anchors(rows: pa.Table) -> pa.Table:
        h, again, _ = _counted(rows)
        values, at = np.unique(np.concatenate(h), return_index=True)
        return _messages([(str(rows.column("part")[0].as_py()), rows.column("bucket")[0].as_py(), values.tobytes(), np.packbits(again[at]).tobytes())])

    def spread_anchors(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(v.as_buffer(), np.uint32) for v in answers.column("h"))])
        out = []
        for block, bucket, v in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), rows.column("h"), strict=True):
            k = np.frombuffer(v.as_buffer(), np.uint32)
            if (m := np.isin(k, known)).any():
                out.append((block, bucket, k[m].tobytes(), None))
        return _messages(out)

    n_parts = -(-blocks.count() // group_blocks)

    def answered(asked: DataFrame, answer: Callable, reduce: Callable, spread: Callable) -> DataFrame:
        """What the buckets answer to each block: at once, or to groups of blocks, which pass it on."""
        if n_parts <= 1:
            return asked.groupBy("bucket").applyInArrow(answer, MESSAGE)
        asked = asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_parts)))
        reduced = asked.groupBy("bucket", "part").applyInArrow(reduce, MESSAGE)
        told = reduced.groupBy("bucket").applyInArrow(answer, MESSAGE).withColumn("part", F.col("block").cast("long"))
        return asked.groupBy("bucket", "part").cogroup(told.groupBy("bucket", "part")).applyInArrow(spread, MESSAGE)

    anchors = answered(blocks.mapInArrow(ask_anchors, MESSAGE), answer_anchors, reduce_anchors, spread_anchors)

    def ask_stretches(state: pa.Table, answers: pa.Table) -> pa.Table:
        b, h, x = [], [], []
        block = ""
        for row in state.to_pylist():
            block, rows = row["block"], unpacked(row["body"])
            chunk, ids = _chunk(rows), _ids(rows)
            at, anchor, place, key = _windows(chunk, words, seed)
            found, _ = _distinct_anchors(chunk, at, anchor)
            known = dict(zip(answers.column("bucket").to_pylist(), answers.column("h"), strict=True))
            again = np.zeros(len(found), bool)
            for bucket, i, j in slices(bucket_of(found, n_buckets)):
                if bucket in known:
                    again[i:j] = np.isin(found[i:j].astype(np.uint32), np.frombuffer(known[bucket].as_buffer(), np.uint32))
            if not len(found):
                continue
            begin, one, two = _stretches(place, key)
            last = np.append(begin[1:], len(place)) - 1
            maybe = again[np.searchsorted(found, anchor[begin])]
            begin, last, one, two = begin[maybe], last[maybe], one[maybe], two[maybe]
            own, bucket = ids[chunk.doc[at[begin]]], bucket_of(anchor[begin], n_buckets)
            # Equal stretches of the block are one, of the smallest id.
            order = np.lexsort((own, two, one, bucket))
            begin, last, one, two, own, bucket = (v[order] for v in (begin, last, one, two, own, bucket))
            first = np.ones(len(begin), bool)
            first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (bucket[1:] != bucket[:-1])
            begin, last, one, own, bucket = (v[first] for v in (begin, last, one, own, bucket))
            said = Words(chunk)
            a, z = said.start[at[begin]], said.end[at[last] + words - 1]
            for k, i, j in slices(bucket):
                b.append(k)
                h.append(one[i:j].tobytes())
                x.append(_stretch_body(z[i:j] - a[i:j], (said.text[p:q] for p, q in zip(a[i:j].tolist(), z[i:j].tolist(), strict=True)), own[i:j]))
        return pa.Table.from_batches([_message(block, b, h, x)])

    def answer_stretches(rows: pa.Table) -> pa.Table:
        names, size, own, text = _opened(rows)
        offsets = np.concatenate([[0], np.cumsum(size)])
        # In parts, since a part's arrays are many times its bytes.
        found = []
        for i, j in pieces(offsets):
            chunk = Chunk(np.frombuffer(text, np.uint8)[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key, at = chunk.grams(words)
            found.append((key, chunk.start[at] + offsets[i], chunk.end[at + words - 1] + offsets[i], chunk.doc[at] + i))
        key, begin, end, of = (np.concatenate(v) for v in zip(*found, strict=True))
        next_to = np.concatenate([[False], of[1:] == of[:-1]]) if len(of) else np.zeros(0, bool)
        again = _earlier(key, own[of], begin, end, text, next_to)
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        marks = np.zeros(len(own), np.uint16)
        np.bitwise_or.at(marks, of[again], (1 << nth[again]).astype(np.uint16))
        return _marked(rows, names, marks)

    asked = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(ask_stretches, MESSAGE)
    earlier = written(answered(asked, answer_stretches, _reduced, _spread).select("block", "h", "x"), "repeats")

    def remove(state: pa.Table, answers: pa.Table) -> pa.Table:
        found = [np.concatenate([np.empty(0, kind), *(np.frombuffer(v.as_buffer(), kind) for v in answers.column(c))]) for c, kind in (("h", np.uint64), ("x", np.uint16))]
        parts = [_removed(unpacked(body.as_py()), *found, words, seed, verbatim) for body in state.column("body")]
        return pa.Table.from_batches(parts, schema=parts[0].schema if parts else arrow)

    carried = [df.schema[c] for c in carry]
    repeats = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    result = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", repeats)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(result)
    out = blocks.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(remove, result)
    return out.select(F.col("id").alias(id_col), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "n_words", "n_removed", "kept_text", "repeats")


def _removed(rows: pa.RecordBatch, names: np.ndarray, marks: np.ndarray, words: int, seed: int, verbatim: bool) -> pa.RecordBatch:
    """What is left of each text of a block; names, marks: its stretches of which an earlier document of another block has windows, and which ones."""
    data, offsets = buffers(rows.column(1))
    chunk, ids = Chunk(data, offsets), _ids(rows)
    at, _, place, key = _windows(chunk, words, seed)
    own, said = ids[chunk.doc[at]] if len(at) else np.empty(0, np.int64), Words(chunk)
    next_to = np.concatenate([[False], at[1:] == at[:-1] + 1]) if len(at) else np.zeros(0, bool)
    again = _earlier(key, own, said.start[at], said.end[at + words - 1] if len(at) else at, said.text, next_to)
    if len(names) and len(at):
        begin, one, _ = _stretches(place, key)
        order = np.argsort(names)
        names, marks = names[order], marks[order]
        where = np.minimum(np.searchsorted(names, one), len(names) - 1)
        mark = np.where(names[where] == one, marks[where], 0)
        length = np.diff(np.append(begin, len(at)))
        nth = np.arange(len(at)) - np.repeat(begin, length)
        again |= (np.repeat(mark, length) >> nth.astype(np.uint16) & 1).astype(bool)
    gone = covered(len(chunk.hash), at[again], words)
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[chunk.first[1:]] - total[chunk.first[:-1]]
    # Maximal runs of removed words; a run ends with its document.
    begin, end = gone.copy(), gone.copy()
    begin[1:] &= ~gone[:-1] | (chunk.doc[1:] != chunk.doc[:-1])
    end[:-1] &= ~gone[1:] | (chunk.doc[1:] != chunk.doc[:-1])
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    in_doc = chunk.doc[start]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(in_doc, np.arange(chunk.n_docs + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start - chunk.first[in_doc]), pa.array(stop - start)], names=["start", "length"]),
    )
    whole, texts = data.tobytes(), []
    for d in range(chunk.n_docs):
        text = whole[offsets[d] : offsets[d + 1]]
        if verbatim and not n_removed[d]:
            texts.append(text)
            continue
        found = text.split()
        if n_removed[d]:
            keep = ~gone[chunk.first[d] : chunk.first[d + 1]]
            found = [found[i] for i in np.flatnonzero(keep)]
        texts.append(b" ".join(found))
    columns = [rows.column(0), *rows.columns[2:], pa.array(chunk.n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), spans]
    return pa.RecordBatch.from_arrays(columns, names=["id", *(f"c{i}" for i in range(len(rows.columns) - 2)), "n_words", "n_removed", "kept_text", "repeats"])
