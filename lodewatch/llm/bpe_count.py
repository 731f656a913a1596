"""Token counts by heap-and-linked-list byte-pair merging.

A sentence's count is its initial symbols less the merges made in it: symbols
stand in a doubly linked list, a heap holds the adjacent pairs that the
vocabulary has, and the pair of the lowest rank (then the leftmost) is popped
and merged until none is left.  No identifiers are looked up or emitted.

No piece of the vocabulary holds a space mark after another character, so no
merge joins a word to the space after it: runs of spaces with the word behind
them are merged alone, and counts of such runs are remembered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewatch.llm.common import id_and_text
from lodewatch.llm.pieces import SPACE, PieceModel, piece_model

#: Word counts that a worker remembers; beyond, it starts anew. A matter of speed alone.
MEMORY = 800_000

_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the tokens that a SentencePiece BPE model makes of a text."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        # Equal scores share a rank, so that the leftmost of them goes first.
        order = {s: i for i, s in enumerate(sorted(set(model.scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in model.scores.items()}
        self._known: dict[str, int] = {}

    def merged(self, run: str) -> int:
        """The tokens of a run of characters, in which spaces are marked already."""
        rank, n = self.rank, len(run)
        symbol = list(run)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := run[i : i + 2]) in rank]
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = right[i]
            if j >= n or symbol[i] is None or symbol[j] is None or len(symbol[i]) + len(symbol[j]) != len(pair) or symbol[i] + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = pair, None
            k = right[i] = right[j]
            merges += 1
            if k < n:
                left[k] = i
                if (p := pair + symbol[k]) in rank:
                    heappush(heap, (rank[p], i, p))
            h = left[i]
            if h >= 0 and (p := symbol[h] + pair) in rank:
                heappush(heap, (rank[p], h, p))
        # A character that no piece has stays alone and stands as its bytes.
        return n - merges + sum(len(c.encode()) - 1 for c in symbol if c is not None and len(c) == 1 and c not in rank)

    def count(self, text: str) -> int:
        known, total = self._known, 0
        for run, times in Counter(self.model.runs(text)).items():
            n = known.get(run)
            if n is None:
                n = self.merged(run.replace(" ", SPACE))
                if len(run) < 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[run] = n
            total += n * times
        return total


def counter(model_path: str) -> PieceCounter:
    if model_path not in _counters:
        _counters[model_path] = PieceCounter(piece_model(model_path))
    return _counters[model_path]


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(df: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``model_path`` is a SentencePiece BPE model which every executor has under
    that path. One narrow pass, nothing is shuffled. Null and empty texts have
    0 tokens; a null id stays null; repeated rows are counted one by one; an
    empty table gives an empty table; other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            texts = batch.column("text")
            n_tokens = [count(x.as_py()) for x in texts]
            n_bytes = [x.as_buffer().size for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = id_and_text(df, id_col, text_col).mapInArrow(each, SCHEMA)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
