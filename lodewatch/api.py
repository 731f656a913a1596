"""The two things that the engine does from end to end: files to correlated groups, events to scored threats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.operators import correlate, threat
from lodewatch.shared import discard, steps, table_path, written
from lodewatch.sources import readers, splits, writers

#: Bytes of input files for which the events are cut into another slice, and the most slices.
SLICE_BYTES, SLICES = 8 << 20, 16
#: Slices in a share of the groups that are assembled at once.
SHARE = 4


@dataclass(frozen=True)
class Correlation:
    """``events`` with their ``component``, ``assembled`` groups, and ``groups`` after their deduplication.

    ``grouped``: the events as they are kept in ``path``, with the number of their group, which is a column of eight bytes in place of 64 digits.
    What is written of them is made of one of so many ``slices`` of the groups after the other.
    """

    grouped: DataFrame
    path: str
    slices: int = 1

    @cached_property
    def events(self) -> DataFrame:
        return correlate.named(self.grouped, self.grouped)

    @cached_property
    def assembled(self) -> DataFrame:
        return self._named(correlate.assemble(self.grouped, "group_"), self.grouped)

    def _named(self, groups: DataFrame, heads: DataFrame) -> DataFrame:
        out = correlate.named(groups, heads)
        return out.select("component", *(c for c in out.columns if c != "component")).withColumn("corr_id", correlate.corr_id(out, "component"))

    def _slice(self, of: int) -> DataFrame:
        """The events of a slice of the actions, as one group may have most events."""
        return self.grouped.where(correlate.in_slice(F.xxhash64("group_", *correlate.SIGNATURE), self.slices) == of)

    def _heads(self) -> DataFrame:
        """The events that name groups, written."""
        return written(self.grouped.where("first_").select("group_", "event_id", "first_"), "heads")

    def kept_groups(self, delete: bool = False) -> DataFrame:
        """``assembled``, written: of a slice of the actions after the other, so that no more events lie in shuffle files; ``delete``: the kept events go then."""
        spark, shares = self.grouped.sparkSession, -(-self.slices // SHARE)
        path = table_path(spark, "assembled")
        with steps(spark):
            heads, paths, counts = self._heads(), [table_path(spark, "actions") for _ in range(self.slices)], table_path(spark, "unique")
            for i, aside in enumerate(paths):
                own = written(correlate.actions_of(self._slice(i), "group_"), "actions", aside)
                unique = correlate.unique_of(own, "group_")  # an action is in one slice, so counts of slices add up
                unique.write.mode("append").parquet(counts)
            if delete:
                discard(spark, self.path)
            actions = spark.read.schema(own.schema).parquet(*paths)
            unique = spark.read.schema(unique.schema).parquet(counts).groupBy("group_").agg(F.sum("unique_events").alias("unique_events"))
            for i in range(shares):
                share = correlate.in_slice("group_", shares) == i
                made = self._named(correlate.of_actions(actions.where(share), unique.where(share), "group_"), heads)
                made.write.mode("append").parquet(path)
        return spark.read.schema(made.schema).parquet(path)

    @cached_property
    def groups(self) -> DataFrame:
        return correlate.dedup_groups(self.assembled)

    def nested(self, per_part: int = 1000) -> DataFrame:
        """The events of each group as arrays in parts."""
        return correlate.named(correlate.nested(self.grouped, "group_", per_part), self.grouped)

    def _kept_nested(self, delete: bool, per_part: int = 1000) -> Iterator[DataFrame]:
        """``nested``, a slice of the groups after the other.

        Its actions are written before, a slice of them after the other; ``delete``: the kept events go then.
        """
        spark = self.grouped.sparkSession
        heads, path = self._heads(), table_path(spark, "actions")
        for i in range(self.slices):
            made = correlate.collapse(self._slice(i), "group_")
            made.write.mode("append").parquet(path)
        if delete:
            discard(spark, self.path)
        actions = spark.read.schema(made.schema).parquet(path)
        for i in range(self.slices):
            yield correlate.named(correlate.in_parts(actions.where(correlate.in_slice("group_", self.slices) == i), "group_", per_part), heads)

    def write(self, path: str, compression: str | None = None, delete: bool = False, per_part: int = 1000, merged: bool = True) -> None:
        """K1: ``groups`` with their events in parts, and ``meta``, as JSON lines in two folders; ``delete``: the kept events go as soon as they are read.

        merged: False for all groups, as they are before their deduplication.
        """
        with steps(self.grouped.sparkSession):
            groups = self.kept_groups()
            groups = written(correlate.dedup_groups(groups), "groups") if merged else groups
            writers.meta(self.grouped, groups).write.mode("overwrite").json(f"{path}/meta")
            for i, nested in enumerate(self._kept_nested(delete, per_part)):
                writers.write_groups(groups, f"{path}/groups", nested, mode="append" if i else "overwrite", compression=compression)

    def write_document(self, path: str, compression: str | None = None, delete: bool = False) -> None:
        """K1: one JSON document of ``meta`` and all groups with their events, over the files of a folder; ``delete``: the kept events go as soon as they are read."""
        spark = self.grouped.sparkSession
        with steps(spark):
            groups, rows = written(correlate.dedup_groups(self.kept_groups()), "groups"), table_path(spark, "document")
            meta = written(writers.meta(self.grouped, groups), "meta")
            for nested in self._kept_nested(delete):
                made = writers.document_rows(groups, nested)
                made.write.mode("append").parquet(rows)
            writers.write_document_rows(spark.read.schema(made.schema).parquet(rows), path, meta, compression=compression)


def correlate_files(spark: SparkSession, paths: dict[str, str | None] | Sequence[str], sources: dict[str, str] | None = None, window: int = correlate.TIME_WINDOW, script_window: int = correlate.SCRIPT_WINDOW, pid_gap: int | None = None, rules: Sequence[str] = correlate.RULES, normalizers: readers.Normalizers | None = None, delete: bool = False, ids: bool = True) -> Correlation:
    """Reads files or folders of any known format, links their events by the rules, assembles and deduplicates groups.

    The events are read and parsed once, and written in slices; so are the grouped ones, which all that follows reads, and each
    slice goes when its events are grouped.  Links are between the events' numbers in the order of their ids, eight bytes in
    place of 64, and so are groups.  What is written on the way is deleted.

    delete: so are the inputs, as soon as they are read; for copies that are made for this call, as text is the largest of all forms.
    ids: False where groups alone are asked for; of the events' ids only those that name groups are kept, as ids are most of an event.
    """
    kept = table_path(spark, "grouped")
    slices = min(SLICES, 1 + sum(splits.total_bytes(spark, p) for p in paths) // SLICE_BYTES)
    with steps(spark):
        path = table_path(spark, "events")
        events = (normalizers or readers.Normalizers()).ingest(spark, paths, sources)
        events = written(events.withColumn("slice_", correlate.in_slice(correlate.first_digits(events), slices)), "events", path, "slice_", slices)
        for p in paths if delete else ():
            discard(spark, p)
        ranked = correlate.ranked(events)
        if "slice_" not in ranked.columns:
            discard(spark, path)
        short = ranked.drop("slice_").withColumn("event_id", F.col("rank_"))
        links = correlate.links(short, window, script_window, pid_gap, rules)
        assign = correlate.assign_ranked if ids else partial(correlate.assign_ranked, ids=False)
        grouped = assign(ranked, links, kept, slices, lambda s: discard(spark, f"{path}/slice_={s}"))
    return Correlation(grouped, kept, slices)


@dataclass(frozen=True)
class Analysis:
    results: DataFrame
    summary: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def document(self) -> str:
        return writers.threat_document(self.summary, self.results, self.nodes, self.edges)

    def write(self, path: str) -> None:
        writers.write_threats(path, self.summary, self.results, self.nodes, self.edges)


def analyze(events: DataFrame, reputation_ip: threat.Source, reputation: threat.Source, quota: int | None = None) -> Analysis:
    """What the analysis service answers, for events as they are or for ``readers.threat_events``; with a quota, for its first rows.

    Reputations are tables, or functions that answer a table of what is asked;
    with a quota, these are asked for the targets of its rows alone.
    """
    order = ("us", "event_id") if {"us", "event_id"} <= set(events.columns) else ("doc", "pos")
    found = threat.targets(events, order)
    if order[0] != "us":
        found = found.withColumns({"us": F.unix_micros(F.try_to_timestamp("first_ts")), "event_id": F.concat_ws(":", *order)})
    if quota is not None:
        found = written(threat.capped(found, quota), "capped")
    reputation_ip, reputation = threat.answered(reputation_ip, threat.asked_addresses(found), "addresses"), threat.answered(reputation, threat.asked_targets(found), "targets-asked")
    results = threat.scored(found, reputation_ip, reputation)
    if quota is not None:
        results = written(results, "results")
    return Analysis(results, threat.summary(results), threat.graph_nodes(results), threat.graph_edges(results))


def analyze_file(spark: SparkSession, path: str, reputation_ip: threat.Source, reputation: threat.Source, quota: int | None = threat.REQUEST_QUOTA) -> Analysis:
    """An uploaded document, which is a ``.json`` file."""
    if not path.endswith(".json"):
        raise ValueError("only .json files are accepted")
    return analyze(readers.threat_events(spark, path), reputation_ip, reputation, quota)


def health() -> dict[str, str]:
    return {"status": "ok"}
