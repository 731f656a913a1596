"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

The cost of a piece of a document is estimated as its length plus a share of
its length squared, for attention within the piece; a sequence costs the sum of
its pieces.  Documents are cut into whole sequences first.  The remainders of a
block of documents, longest first, each go whole to the sequence of the lowest
cost that has room for them; only what no sequence has room for is cut.  A
block opens just the sequences that its remainders fill: whole ones, and for
the rest of the division one of each power of two in it, which needs no
padding.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewatch.llm.common import id_and_text

#: Tokens whose remainders are packed together.
BLOCK_TOKENS = 2_000_000
#: Attention's share: a piece of n tokens costs n + n * n / QUADRATIC.
QUADRATIC = 1024.0

Encode = Callable[[str], np.ndarray]
_encoders: dict[str, Encode] = {}


def encoder(path: str) -> Encode:
    """Encodes as the ``tokenizers`` file says, special tokens inside texts included, none added.

    A byte-level BPE whose identifiers are the ranks of its merges is run by
    tiktoken, which gives the same identifiers several times faster; any other
    file is run by tokenizers.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _encoders[path] = _by_rank(spec) or _by_library(path)
    return _encoders[path]


def _by_library(path: str) -> Encode:
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


def _by_rank(spec: dict) -> Encode | None:
    import public_tokenizers
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model.get("type") != "BPE" or any(pre.get(k) != v for k, v in plain.items()) or spec.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges"):
        return None
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec.get("added_tokens", [])):
        return None
    # Byte-level vocabularies write each byte as a printable character.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    singles = [k for k in vocab if len(k) == 1]
    if len(singles) != 256 or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocab) != 256 + len(pairs):
        return None
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items()}
    t = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: t.encode_to_numpy(text, allowed_special="all")


def assign(lengths: Sequence[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs remainders into sequences of ``capacity`` tokens, and smaller ones for what is left.

    lengths: in any order, each below the capacity.  Longest first, each goes
    whole to the sequence of the lowest cost that has room for it; those that
    no sequence has room for are cut at last, to fill what is left, the
    lowest-cost sequences first.  Returns pieces (item, from, length,
    sequence, offset) and the number of sequences.  Equal lengths go in their
    given order.  Every sequence is full.
    """
    whole, rest = divmod(sum(lengths), capacity)
    rooms = [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    cost = lambda n: n + n * n / QUADRATIC
    # A small sequence starts at the cost of the tokens that it lacks.
    heap = [(cost(capacity - room), s) for s, room in enumerate(rooms)]
    heapify(heap)
    used, out = [0] * len(rooms), []
    # Sequences too full for the present length, by their room: they come back once lengths are down to it.
    parked: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]

    def put(item: int, at: int, n: int, c: float, s: int) -> None:
        out.append((item, at, n, s, used[s]))
        used[s] += n
        if used[s] < rooms[s]:
            heappush(heap, (c + cost(n), s))

    uncut, last = [], capacity
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[item]
        for room in range(n, last):
            for x in parked[room]:
                heappush(heap, x)
            parked[room].clear()
        last = n
        while heap:
            c, s = heappop(heap)
            if rooms[s] - used[s] >= n:
                put(item, 0, n, c, s)
                break
            parked[rooms[s] - used[s]].append((c, s))
        else:
            uncut.append(item)
    for x in parked:
        heap += x
    heapify(heap)
    for item in uncut:
        at = 0
        while at < lengths[item]:
            c, s = heappop(heap)
            n = min(lengths[item] - at, rooms[s] - used[s])
            put(item, at, n, c, s)
            at += n
    return out, len(rooms)


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Packs all rows: a row for each piece of a document in a sequence.

    Returns the id, ``start`` (tokens of the document before the piece),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and
    with ``with_ids`` the piece's ``ids``.  A document is its tokens and then
    ``end_id``; a null or empty text is ``end_id`` alone.  Rows of equal ids
    are packed one by one, a null id stays null, an empty table gives an empty
    table, other columns are ignored.  One narrow pass: blocks are cut within
    the partitions of the scan, and a partition's rows give the same result
    whenever it is run again.
    """
    fields = [T.StructField(n, T.LongType()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    names = [f.name for f in schema.fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []  # id, start, length, crc, doc_tokens, sequence, offset
        bodies: list[np.ndarray] = []
        tails: list[tuple[int | None, int, int, np.ndarray]] = []  # id, start, doc_tokens, ids
        size = 0

        def put(doc: int | None, start: int, ids: np.ndarray, total: int, to: int, offset: int) -> None:
            rows.append((doc, start, len(ids), crc32(ids.astype("<u4", copy=False).tobytes()), total, to, offset))
            if with_ids:
                bodies.append(ids)

        def close() -> None:
            nonlocal sequence, size
            placed, n = assign([len(t[3]) for t in tails], capacity)
            for item, at, length, s, offset in placed:
                doc, start, total, ids = tails[item]
                put(doc, start + at, ids[at : at + length], total, sequence + s, offset)
            sequence += n
            tails.clear()
            size = 0

        def drain() -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            if with_ids:
                flat = np.concatenate(bodies).astype(np.int32) if bodies else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int32)), pa.array(flat)))
            rows.clear()
            bodies.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([encode(text.as_py()), end])
                total = len(ids)
                full = total - total % capacity
                for at in range(0, full, capacity):
                    put(doc, at, ids[at : at + capacity], total, sequence, 0)
                    sequence += 1
                if full < total:
                    tails.append((doc, full, total, ids[full:]))
                size += total
                if size >= BLOCK_TOKENS:
                    close()
                    yield drain()
        close()
        yield drain()

    out = id_and_text(df, id_col, text_col).mapInArrow(each, schema)
    return out.withColumnRenamed("id", id_col)
