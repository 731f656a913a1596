"""Phrases that hold together, counted by suffix automata over shards of text.

Texts are read into shards of one language and some megabytes, each word as its
number in the shard's dictionary.  A shard's generalised suffix automaton, of
bounded depth over all its pieces, has a state for each set of places at which
phrases end; the set's size is how often they occur, and its suffix link leads to the
state of the longest shorter suffix that occurs more often.  States are made
by sorting all places by the words before them, read backwards, which puts the tree
of suffix links in order; they are the same as when words are added one by one.

Most phrases of a text are there once, so sending all would be more than there is
text.  A phrase is no more frequent than its parts; so depths are taken one after the
other.  At each depth the shards' automata give their phrases of that many words
and the sizes of their sets; counts meet in buckets, packed, and each shard
learns the names of those that reach the least count.  A longer phrase is counted
if its two parts of a word less have names, and is the pair of them: nothing that
reaches the least count is left out, and nothing is counted by a hash.

A phrase whose count a phrase of a word more nearly reaches is subsumed by it.
Both ways to drop a word are looked at: the first word, which follows the
suffix link, and the last, which goes back along the transition.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.llm.blocks import bucket_of, slices
from lodewatch.llm.common import written
from lodewatch.llm.textkernels import mix
from lodewatch.shared import discard, released, table_path

#: Bytes of text in a shard, unless one text is longer, and of all open shards of a task.
SHARD_BYTES, OPEN_BYTES = 8 << 20, 32 << 20
#: What a missing language counts as.
UNKNOWN = "und"
#: Bytes that end a piece, and bytes between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
#: Words of all texts for a bucket in which counts meet.
BUCKET_WORDS = 2_000_000
SHARDS = "shard long, lang string, n_words long, state binary"
FOUND = "shard long, lang string, state binary, phrase string, k int, f long, spelled int"


@dataclass(frozen=True)
class Automaton:
    """States of a generalised suffix automaton of bounded depth.

    ``shortest`` and ``longest``: lengths of a state's phrases, which all end at
    the ``count`` places of ``order`` from ``start`` on, one of which is ``end``;
    ``link``: the state of the longest shorter suffix, or -1.
    """

    shortest: np.ndarray
    longest: np.ndarray
    start: np.ndarray
    count: np.ndarray
    end: np.ndarray
    link: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, depth: int) -> Automaton:
        """Of words as numbers from 0; a negative number ends a piece."""
        at = np.flatnonzero(words >= 0)
        before = np.full((depth, len(at)), -1, words.dtype)
        inside = np.ones(len(at), bool)
        for d in range(depth):
            inside = inside & (at >= d)
            inside[inside] = words[at[inside] - d] >= 0
            before[d, inside] = words[at[inside] - d]
        order = np.lexsort(before[::-1])
        before = before[:, order]
        fresh = np.ones(len(at), bool)
        changed = np.zeros(len(at), bool)
        starts, counts, depths = [], [], []
        for d in range(depth):
            changed[1:] |= before[d, 1:] != before[d, :-1]
            fresh[1:] = changed[1:]
            first = np.flatnonzero(fresh)
            size = np.diff(np.append(first, len(at)))
            there = before[d, first] >= 0
            starts.append(first[there]), counts.append(size[there]), depths.append(np.full(int(there.sum()), d + 1))
        start, count, length = map(np.concatenate, (starts, counts, depths))
        # Phrases of one last place and one count have the same ends: they are one state.
        by = np.lexsort((length, count, start))
        start, count, length = start[by], count[by], length[by]
        new = np.ones(len(by), bool)
        new[1:] = (start[1:] != start[:-1]) | (count[1:] != count[:-1])
        head = np.flatnonzero(new)
        longest = length[np.append(head[1:], len(by)) - 1] if len(head) else length
        start, count, shortest = start[head], count[head], length[head]
        # The link's phrase is one shorter than the shortest: the last of that depth that begins at or before the state.
        link = np.full(len(head), -1)
        for d in range(1, depth):
            of = np.flatnonzero((shortest <= d) & (longest >= d))
            of = of[np.argsort(start[of], kind="stable")]
            mine = np.flatnonzero(shortest == d + 1)
            link[mine] = of[np.searchsorted(start[of], start[mine], side="right") - 1]
        return cls(shortest, longest, start, count, at[order[start]] if len(at) else start, link, at[order])

    def ends(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states, and where it ends, for all places of all of them."""
        n = self.count[states]
        which = np.repeat(np.arange(len(states)), n)
        return which, self.order[self.start[states][which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]]

    def of_length(self, k: int) -> np.ndarray:
        """The states of the phrases of k words, one for each of them."""
        return np.flatnonzero((self.shortest <= k) & (self.longest >= k))

    def phrases(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last place, length and count of each phrase of ``least`` to ``most`` words."""
        low, high = np.maximum(self.shortest, least), np.minimum(self.longest, most)
        many = np.maximum(high - low + 1, 0)
        state = np.repeat(np.arange(len(many)), many)
        length = low[state] + np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many)
        return self.end[state], length, self.count[state]


def _read(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, int]:
    """Distinct words, and all texts as numbers of words with -1 between pieces."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    kind = _KIND[data]
    word = kind == 0
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[word]))
    coded = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    cut = np.zeros(len(start), np.int64)
    cut[1:] = piece[1:] != piece[:-1]
    ids = np.full(len(start) + int(cut.sum()), -1, np.int32)
    ids[np.arange(len(start)) + np.cumsum(cut)] = coded.indices.to_numpy()
    return coded.dictionary.cast(pa.string()), ids, len(start)


def _packed(**columns: pa.Array | np.ndarray) -> bytes:
    """Columns in one compressed row; integers byte by byte, all lowest first, which compresses better."""
    row, names = [], []
    for name, c in columns.items():
        if isinstance(c, np.ndarray):
            row.append(pa.array([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes()], pa.binary()))
            names.append(f"{name} {c.dtype.str}")
        else:
            row.append(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
            names.append(name)
    batch = pa.RecordBatch.from_arrays(row, names=names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: pa.Scalar) -> dict[str, pa.Array | np.ndarray]:
    with pa.ipc.open_stream(body.as_buffer()) as source:
        batch = source.read_next_batch()
    out = {}
    for full, column in zip(batch.schema.names, batch.columns, strict=True):
        name, *kind = full.split()
        if kind:
            kind = np.dtype(kind[0])
            planes = np.frombuffer(column[0].as_buffer(), np.uint8).reshape(kind.itemsize, -1)
            out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        else:
            out[name] = column.flatten()
    return out


def _row(kinds: str, **values: object) -> pa.RecordBatch:
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in kinds.split(", "))])
    return pa.RecordBatch.from_pylist([values], schema)


def shards(df: DataFrame, lang_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """The written table of shards."""
    own = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def done(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal name
            words, ids, n = _read(held.pop(lang))
            del sizes[lang]
            if n:
                yield _row(SHARDS, shard=name, lang=lang, n_words=n, state=_packed(words=words, ids=ids))
                name += 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                body = text.as_buffer().to_pybytes()
                if sizes.get(lang) and sizes[lang] + len(body) > SHARD_BYTES:
                    yield from done(lang)
                held.setdefault(lang, []).append(body)
                sizes[lang] = sizes.get(lang, 0) + len(body) + 1
                if sum(sizes.values()) > OPEN_BYTES:
                    yield from done(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from done(lang)

    return written(own.mapInArrow(each, SHARDS), "shards", path=path)


def _state(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A shard's words, their numbers by place (-1: a break), and the name of the phrase of one depth less that ends at each place."""
    own = _unpacked(row["state"])
    names = own["names"][own["codes"] if "codes" in own else own["ids"]] if "names" in own else np.empty(0, np.int64)
    return own["words"], own["ids"], names


class Sent:
    """What a shard sends at a depth, in the order of buckets: its states (or words), their counts and keys."""

    def __init__(self, depth: int, words: pa.Array, ids: np.ndarray, names: np.ndarray, buckets: int) -> None:
        if depth == 1:
            self.made, states, n = None, np.arange(len(words)), np.bincount(ids[ids >= 0], minlength=len(words))
            bucket = bucket_of(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False), buckets)
            order = np.argsort(bucket, kind="stable")
            self.keys = {"word": words.take(pa.array(order))}
        else:
            self.made = Automaton.of(ids, depth)
            states = self.made.of_length(depth)
            end = self.made.end[states]
            known = (names[end - 1] >= 0) & (names[end] >= 0)
            states, end = states[known], end[known]
            n, a, b = self.made.count[states], names[end - 1], names[end]
            bucket = bucket_of(mix(a.view(np.uint64) + mix(b.view(np.uint64))), buckets)
            order = np.lexsort((b, a, bucket))
            self.keys = {"a": a[order], "b": b[order]}
        self.states, self.n, self.bucket = states[order], n[order].astype(np.int32), bucket[order]


def _messages(depth: int, buckets: int):
    """What shards send to buckets: words, or pairs of names, with their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                sent = Sent(depth, *_state(row), buckets)
                for to, begin, end in slices(sent.bucket):
                    body = _packed(**{k: v[begin:end] for k, v in sent.keys.items()}, n=sent.n[begin:end])
                    yield pa.RecordBatch.from_pydict({"bucket": [to], "shard": [row["shard"].as_py()], "lang": [row["lang"].as_py()], "body": pa.array([body], pa.binary())})

    return each


def _answers(depth: int, least: int):
    """A bucket's sums: to each shard the places in its message of frequent phrases, their names and counts, and whether it is the one to spell them."""

    def each(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        langs, of = rows.column("lang").combine_chunks().dictionary_encode(), rows.column("shard").to_numpy()
        lang = langs.indices.to_numpy()
        parts = [_unpacked(x) for x in rows.column("body")]
        size = [len(p["n"]) for p in parts]
        source = np.repeat(np.arange(len(parts), dtype=np.int32), size)
        n = np.concatenate([p["n"] for p in parts])
        if depth == 1:
            code = pa.concat_arrays([p["word"] for p in parts]).dictionary_encode().indices.to_numpy().astype(np.int64)
            _, group = np.unique(code * len(langs.dictionary) + lang[source], return_inverse=True)
        else:
            a, b = (np.concatenate([p[c] for p in parts]) for c in ("a", "b"))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.zeros(len(a), np.int64)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.empty(len(a), np.int64)
            group[order] = np.cumsum(new)
        total = np.zeros(group.max() + 1, np.int64)
        np.add.at(total, group, n)
        first = np.full(len(total), len(parts), np.int32)
        np.minimum.at(first, group, source)
        kept = np.flatnonzero(total[group] >= least)
        cut, begin = np.searchsorted(source[kept], np.arange(len(parts) + 1)), np.cumsum([0, *size])
        # Names are dense: those that are not frequent have none.
        name = np.cumsum(total >= least) - 1
        out = []
        for i in range(len(parts)):
            at = kept[cut[i] : cut[i + 1]]
            if len(at):
                g = group[at]
                mine = first[g] == i
                out.append({"shard": int(of[i]), "bucket": bucket, "body": _packed(place=(at - begin[i]).astype(np.int32), name=(bucket << 36) + name[g]), "spelled": _packed(at=np.flatnonzero(mine).astype(np.int32), f=total[g[mine]])})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary()), ("spelled", pa.binary())]))

    return each


def trimmed(ids: np.ndarray, names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What longer phrases can be in: words of runs that two named phrases of ``depth`` words, one after the other, cover, with -1 between."""
    linked = np.flatnonzero((names[:-1] >= 0) & (names[1:] >= 0)) + 1
    # joint[j]: words j and j + 1 are in one such run, from linked - depth to linked.
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, linked - depth, 1)
    np.add.at(step, linked, -1)
    joint = np.cumsum(step[:-1]) > 0
    kept = joint.copy()
    kept[1:] |= joint[:-1]
    wide = np.where(joint[kept], 1, 2)
    last = (np.cumsum(wide) - 1)[~joint[kept]]
    out = [np.repeat(x[kept], wide) for x in (ids, names)]
    for x in out:
        x[last] = -1
    return out[0], out[1]


def _spelled(words: pa.Array, ids: np.ndarray, end: np.ndarray, k: int) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(ids[end - j])) for j in range(k - 1, -1, -1)), " ")


def _applied(depth: int, most: int, buckets: int):
    """A shard with its answers: what is left of it for longer phrases, and the phrases that it is to spell."""

    def each(state: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("state", pa.binary()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64()), ("spelled", pa.int32())])
        if not state.num_rows or not answers.num_rows:
            return schema.empty_table()
        row = {c: state.column(c)[0] for c in ("shard", "lang", "state")}
        words, ids, names = _state(row)
        sent = Sent(depth, words, ids, names, buckets)
        begin = {to: x for to, x, _ in slices(sent.bucket)}
        at, name, spell, f = [], [], [], []
        for bucket, *bodies in zip(*(answers.column(c) for c in ("bucket", "body", "spelled")), strict=True):
            body, spelled = map(_unpacked, bodies)
            own = sent.states[begin[bucket.as_py()] + body["place"]]
            at.append(own), name.append(body["name"]), spell.append(own[spelled["at"]]), f.append(spelled["f"])
        at, name, spell, f = map(np.concatenate, (at, name, spell, f))
        if depth == 1:
            name_of = np.full(len(words) + 1, -1, np.int64)
            name_of[at] = name
            names, phrase = name_of[ids], words.take(pa.array(spell))
        else:
            names = np.full(len(ids), -1, np.int64)
            which, end = sent.made.ends(at)
            names[end] = name[which]
            phrase = _spelled(words, ids, sent.made.end[spell], depth)
        n = len(phrase)
        out = [pa.Table.from_arrays([pa.nulls(n, pa.int64()), pa.array([row["lang"].as_py()] * n, pa.string()), pa.nulls(n, pa.binary()), phrase, pa.array(np.full(n, depth, np.int32)), pa.array(f), pa.array(np.ones(n, np.int32))], schema=schema)]
        if depth < most:
            ids, names = trimmed(ids, names, depth)
            if len(ids):
                used, renamed = np.unique(ids, return_inverse=True)  # -1 is the first of them
                own = {"words": words.take(pa.array(used[1:])), "ids": (renamed - 1).astype(np.int32)}
                if depth == 1:  # names are of words; the break's is the last
                    own["names"] = np.append(name_of[used[1:]], -1)
                else:
                    own["names"], codes = np.unique(names, return_inverse=True)
                    own["codes"] = codes.astype(np.int32)
                out.append(pa.Table.from_pylist([{"shard": row["shard"].as_py(), "lang": row["lang"].as_py(), "state": _packed(**own), "spelled": 0}], schema))
        return pa.concat_tables(out)

    return each


def phrase_counts(df: DataFrame, least: int, most: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words; (lang, phrase, k, f) of all phrases of 1 to ``most`` words that occur ``least`` times or more."""
    spark = df.sparkSession
    last = table_path(spark, "shards")
    state = shards(df, lang_col, text_col, last)
    totals = written(state.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    found = []
    for depth in range(1, most + 1):
        state = state.select("shard", "lang", "state")
        sent = state.mapInArrow(_messages(depth, buckets), "bucket long, shard long, lang string, body binary")
        answers = sent.groupBy("bucket").applyInArrow(_answers(depth, least), "shard long, bucket long, body binary, spelled binary")
        both = state.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_applied(depth, most, buckets), FOUND)
        # What a depth sends and the shards that it began with go when it is done; the phrases stay.
        path = table_path(spark, f"phrases-{depth}")
        with released(spark):
            both = written(both, f"phrases-{depth}", path=path, by="spelled", values=2)
        discard(spark, last)
        found.append(both.where("spelled = 1").select("lang", "phrase", "k", "f"))
        state, last = both.where("spelled = 0"), f"{path}/spelled=0"
    return totals, functools.reduce(DataFrame.unionByName, found)


def collocations(df: DataFrame, least: int = 100, words: int = 5, percent: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language by how much more often their parts meet than by chance.

    Letters A-Z are lower-cased; texts are cut into pieces at any of
    ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.  n is the
    number of words of a language, f of a phrase how often it occurs within
    pieces.  Candidates have 2 to ``words`` words and a = f >= ``least``.  A cut
    into two parts with l and r occurrences scores floor(1000 * a * n / (l * r)),
    and the cut of the lowest score counts, the first of equals.  Candidates
    inside a longer one with 100 * f(longer) >= percent * a are dropped.
    Returns lang, rank, phrase (words joined by a space), a, l, r, n and score,
    by score and a, highest first, then phrase in byte order.

    A null language is ``und``; null and empty texts have no words; repeated
    rows count as often as they are there; a text is read whole, whatever its
    length.  A language without candidates has no rows, and an empty table gives
    an empty table; other columns are ignored.
    """
    least = max(1, least)
    totals, counts = phrase_counts(df, least, words, lang_col, text_col)
    word = F.split("phrase", " ")
    candidates = counts.where("k >= 2")
    # A subsumer at any distance has a phrase of one word more between, which is as frequent at least, and a candidate.
    shorter = candidates.where("k >= 3").select("lang", F.explode(F.array(F.array_join(F.slice(word, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("k") - 1), " "))).alias("phrase"), "f")
    longer = shorter.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f")))
    cut = kept.select("lang", "phrase", "k", F.col("f").alias("a"), word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    part = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    cut = cut.select("lang", "phrase", "a", "j", part(F.lit(1), F.col("j")).alias("first"), part(F.col("j") + 1, F.col("k") - F.col("j")).alias("rest"))
    for side, f in (("first", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * big("n"), big("l") * big("r"))
    scored = cut.join(totals, "lang").withColumn("score", score.cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "j", "l", "r")).alias("x"))
    over = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
