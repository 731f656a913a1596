"""Targets of correlated events, their reputation, score, summary and entity graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.functions.classify import threat_label, threat_score
from lodewatch.functions.net import is_public_ipv4
from lodewatch.operators.stateful import first_of
from lodewatch.shared import written

# Fixed values. Colors of severities; rows that one request and one run on the command line may look up.
COLORS = {"CRITICAL": "red", "HIGH": "orange", "MEDIUM": "yellow", "LOW": "blue", "CLEAN": "green"}
REQUEST_QUOTA, RUN_QUOTA = 50, 5
# Fixed values. Abuse score above which an address is bad; suspicious votes above which a target is.
ABUSE_LIMIT, SUSPICIOUS_LIMIT = 50, 2


def _any(events: DataFrame, *names: str) -> Column:
    """The first of the columns that the events have and that is not empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names if n in events.columns), F.lit(None).cast("string"))


def extracted(events: DataFrame) -> DataFrame:
    """Adds ``ip``, ``domain`` and ``process_name`` of what can be looked up; rows with neither address nor domain go.

    The address is the first public one of ``dst_ip``, ``ip``, ``src_ip``; the
    domain of ``domain``, ``hostname``, ``url``; the process of
    ``process_name``, ``process``, ``image``, else "unknown".  Columns may be missing.
    """
    ips = [F.when(is_public_ipv4(F.col(c)), F.col(c)) for c in ("dst_ip", "ip", "src_ip") if c in events.columns]
    found = events.withColumns({"ip_": F.coalesce(*ips, F.lit(None).cast("string")), "domain_": _any(events, "domain", "hostname", "url"), "process_": F.coalesce(_any(events, "process_name", "process", "image"), F.lit("unknown"))})
    found = found.drop("ip", "domain", "process_name").withColumnsRenamed({"ip_": "ip", "domain_": "domain", "process_": "process_name"})
    return found.where("ip is not null or domain is not null")


def distinct_targets(found: DataFrame, order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """The first row of each pair of address and domain; null is a value of its own."""
    return first_of(found, ["ip", "domain"], order)


def targets(events: DataFrame, order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """Rows with a public address or a domain; a row with one of them only goes if that was seen before.

    events: see ``extracted``; the order's columns tell all rows apart.  What is
    extracted is written once; the first rows of each address and domain are
    found from the few columns that say so.
    """
    found = written(extracted(events), "targets")
    at = F.struct(*order)
    def lone(c: str, other: str) -> DataFrame:
        """Rows with ``c`` alone that are its first: only rows that have the key are joined."""
        firsts = found.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(at).alias("first_"))
        return found.where(F.col(c).isNotNull() & F.col(other).isNull()).join(firsts, c).where(at <= F.col("first_")).select(*found.columns)

    both = found.where("ip is not null and domain is not null")
    return both.unionByName(lone("ip", "domain")).unionByName(lone("domain", "ip"))


def capped(rows: DataFrame, n: int = REQUEST_QUOTA, order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """L4: the first rows that a quota allows."""
    return rows.orderBy(*order).limit(n)


def drawn(rows: DataFrame, n: int = RUN_QUOTA, seed: int = 1, key: str = "event_id") -> DataFrame:
    """L4: so many rows drawn at random; which ones depends on their ids and the seed alone."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(n)


#: A table of answers, or what makes one from the table of what is asked, such as a client of a service.
Source = DataFrame | Callable[[DataFrame], DataFrame]


def answered(source: Source, asked: DataFrame, name: str) -> DataFrame:
    """The source's answers; those of a function are written, so that it is asked once."""
    return written(source(asked), name) if callable(source) else source


def asked_addresses(targets: DataFrame) -> DataFrame:
    return targets.where("ip is not null").select("ip").distinct()


def asked_targets(targets: DataFrame) -> DataFrame:
    return targets.select(F.explode(F.array("ip", "domain")).alias("target")).where("target is not null").distinct()


def _by_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A left join in which rows without the key are dealt out evenly and find nothing."""
    own = rows.withColumn("key_", F.coalesce(key, F.concat(F.lit("\x00"), F.pmod(F.monotonically_increasing_id(), F.lit(997)))))
    return own.join(table.withColumnRenamed(key, "key_"), "key_", "left").drop("key_")


def ip_answers(targets: DataFrame, reputation_ip: Source) -> DataFrame:
    """An answer for each distinct ``ip``: its reputation, or ``skipped`` (not public) or ``error`` (nothing known).

    reputation_ip: ``ip``, ``abuse_score`` and, if it has one, ``error``; a
    table that stands for the service and its cache, or a function that is
    given the distinct addresses.
    """
    asked = asked_addresses(targets)
    reputation_ip = answered(reputation_ip, asked, "addresses")
    known = reputation_ip if "error" in reputation_ip.columns else reputation_ip.withColumn("error", F.lit(None).cast("string"))
    out = asked.join(known.withColumn("known_", F.lit(True)), "ip", "left")
    skipped = ~is_public_ipv4(F.col("ip"))
    error = F.when(skipped, F.lit(None)).when(F.col("known_").isNull(), "no answer").otherwise(F.col("error"))
    usable = ~skipped & error.isNull()
    score = F.when(usable, F.coalesce("abuse_score", F.lit(0))).otherwise(0).cast("int")
    return out.select("ip", skipped.alias("skipped"), error.alias("error"), score.alias("abuse_score"), (score > ABUSE_LIMIT).alias("is_malicious"))


def target_answers(targets: DataFrame, reputation: Source) -> DataFrame:
    """An answer for each distinct address and domain, as ``target``; unknown ones have an ``error`` and count 0.

    reputation: as in ``ip_answers``; a function is given the distinct targets.
    """
    asked = asked_targets(targets)
    reputation = answered(reputation, asked, "targets-asked")
    known = reputation if "error" in reputation.columns else reputation.withColumn("error", F.lit(None).cast("string"))
    out = asked.join(known.withColumn("known_", F.lit(True)), "target", "left")
    error = F.when(F.col("target") == "", "empty target").when(F.col("known_").isNull(), "no answer").otherwise(F.col("error"))
    count = lambda c: F.when(error.isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("int")
    bad = (count("malicious_count") > 0) | (count("suspicious_count") > SUSPICIOUS_LIMIT)
    return out.select("target", error.alias("error"), count("malicious_count").alias("malicious_count"), count("suspicious_count").alias("suspicious_count"), bad.alias("is_malicious"))


def scored(rows: DataFrame, reputation_ip: DataFrame, reputation: DataFrame) -> DataFrame:
    """Joins the reputations of address and domain, adds ``risk_score``, ``severity``, ``is_suspicious``.

    Missing answers and those with an ``error`` count 0, as in ``ip_answers``
    and ``target_answers``; rows are those of ``targets``, whose addresses are public.
    """
    usable = lambda df: df.where("error is null") if "error" in df.columns else df
    votes = usable(reputation)
    of = lambda c, p: votes.select(F.col("target").alias(c), F.col("malicious_count").alias(f"{p}_mal"), F.col("suspicious_count").alias(f"{p}_sus"))
    out = _by_key(_by_key(_by_key(rows, usable(reputation_ip).select("ip", "abuse_score"), "ip"), of("ip", "ip"), "ip"), of("domain", "dom"), "domain")
    both = lambda c: F.coalesce(F.col(f"ip_{c}"), F.lit(0)) + F.coalesce(F.col(f"dom_{c}"), F.lit(0))
    out = out.withColumn("risk_score", threat_score(F.col("abuse_score"), both("mal"), both("sus")))
    return out.withColumns({"severity": threat_label(F.col("risk_score")), "is_suspicious": F.col("risk_score") > 20}).drop("ip_mal", "ip_sus", "dom_mal", "dom_sus")


def summary(results: DataFrame) -> DataFrame:
    """Totals, and the number of each severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in COLORS]
    return results.agg(F.count("*").alias("total"), F.count_if("is_suspicious").alias("suspicious"), F.count_if(~F.col("is_suspicious")).alias("clean_rows"), *counts)


def top(results: DataFrame, n: int = 5) -> DataFrame:
    """L3"""
    return results.orderBy(F.desc("risk_score"), "event_id").limit(n)


def graph_nodes(results: DataFrame) -> DataFrame:
    """Processes and addresses with the highest risk of their rows; a domain keeps its first row's."""
    row = lambda kind, c: results.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.concat(F.lit(f"{kind}::"), c).alias("node_id"), F.lit(kind).alias("kind"), "risk_score", "us", "event_id")
    highest = row("process", "process_name").unionByName(row("ip", "ip")).groupBy("node_id", "kind").agg(F.max("risk_score").alias("risk_score"))
    first = row("domain", "domain").groupBy("node_id", "kind").agg(F.min_by("risk_score", F.struct("us", "event_id")).alias("risk_score"))
    return highest.unionByName(first).withColumn("severity", threat_label(F.col("risk_score")))


def graph_edges(results: DataFrame) -> DataFrame:
    """An edge from the process to each target of a row; repeats stay."""
    source = F.concat(F.lit("process::"), "process_name")
    text = F.concat(F.col("protocol"), F.lit(" :"), F.col("dst_port").cast("string"))
    to = lambda kind, c: results.where(F.col(c).isNotNull()).select(source.alias("source"), F.concat(F.lit(f"{kind}::"), c).alias("target"), text.alias("label"), "event_id")
    return to("ip", "ip").unionByName(to("domain", "domain"))
