"""Queries for targets, answers, scores and their documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch import api
from lodewatch.operators import correlate, stateful, threat
from lodewatch.plans import queries as Q
from lodewatch.plans.registry import query, with_view
from lodewatch.plans.views import unified
from lodewatch.shared import table_path
from lodewatch.sources import readers, writers


def _dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reputations of some of the view's addresses and domains; others are unknown, and some answers are errors."""
    events = unified(spark, sf_dir)
    ips = events.where("dst_ip <> ''").groupBy(F.col("dst_ip").alias("ip")).agg(F.min_by("k", "event_id").alias("k"))
    k = F.col("k")
    abuse = ips.where(k % 6 != 0).select("ip", (k * 7 % 101).alias("abuse_score"), F.when(k % 4 == 1, "HTTP 500").alias("error"))
    domains = events.where("domain <> ''").groupBy(F.col("domain").alias("target")).agg(F.min_by("k", "event_id").alias("k"))
    votes = ips.withColumnRenamed("ip", "target").unionByName(domains).where(k % 6 != 1)
    return abuse, votes.select("target", F.when(k % 3 == 0, 0).otherwise(k % 5).alias("malicious_count"), (k % 4).alias("suspicious_count"), F.when(k % 7 == 2, "Rate limit (429)").alias("error"))


_DIM = f"""{Q._TARGETS},
ik AS (SELECT dst_ip AS ip, arg_min(k, event_id) AS k FROM u WHERE dst_ip <> '' GROUP BY dst_ip), dk AS (SELECT domain AS target, arg_min(k, event_id) AS k FROM u WHERE domain <> '' GROUP BY domain),
ipa AS (SELECT a.ip, false AS skipped, CASE WHEN k IS NULL OR k % 6 = 0 THEN 'no answer' WHEN k % 4 = 1 THEN 'HTTP 500' END AS error, CASE WHEN k IS NULL OR k % 6 = 0 OR k % 4 = 1 THEN 0 ELSE k * 7 % 101 END::INT AS abuse_score FROM (SELECT DISTINCT ip FROM tg WHERE ip IS NOT NULL) a LEFT JOIN ik USING (ip)),
asked AS (SELECT DISTINCT target FROM (SELECT ip AS target FROM tg UNION ALL SELECT dom FROM tg) WHERE target IS NOT NULL),
votes AS (SELECT ip AS target, k FROM ik UNION ALL SELECT * FROM dk),
ta AS (SELECT target, CASE WHEN k IS NULL OR k % 6 = 1 THEN 'no answer' WHEN k % 7 = 2 THEN 'Rate limit (429)' END AS error, k FROM asked LEFT JOIN votes USING (target)),
tac AS (SELECT target, error, CASE WHEN error IS NOT NULL OR k % 3 = 0 THEN 0 ELSE k % 5 END::INT AS malicious_count, CASE WHEN error IS NOT NULL THEN 0 ELSE k % 4 END::INT AS suspicious_count FROM ta)"""


@query(with_view("SELECT ip, skipped, error, abuse_score, abuse_score > 50 AS is_malicious FROM ipa", _DIM))
def address_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, errors and unknown addresses."""
    return threat.ip_answers(threat.targets(unified(spark, sf_dir)), _dimensions(spark, sf_dir)[0])


@query(with_view("SELECT target, error, malicious_count, suspicious_count, malicious_count > 0 OR suspicious_count > 2 AS is_malicious FROM tac", _DIM))
def target_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19, C8"""
    return threat.target_answers(threat.targets(unified(spark, sf_dir)), _dimensions(spark, sf_dir)[1])


_RESULTS = f"""{_DIM},
raw AS (SELECT tg.*, coalesce(a.abuse_score, 0) * 6 + (coalesce(i.malicious_count, 0) + coalesce(d.malicious_count, 0)) * 120 + (coalesce(i.suspicious_count, 0) + coalesce(d.suspicious_count, 0)) * 40 AS tenths FROM tg LEFT JOIN ipa a ON a.ip = tg.ip LEFT JOIN tac i ON i.target = tg.ip LEFT JOIN tac d ON d.target = tg.dom),
sc AS (SELECT *, least(tenths // 10 + CASE WHEN tenths % 10 > 5 OR tenths % 10 = 5 AND tenths // 10 % 2 = 1 THEN 1 ELSE 0 END, 100)::INT AS risk_score FROM raw),
capped AS (SELECT * FROM sc ORDER BY us, event_id LIMIT 50)"""


@query(with_view("SELECT event_id, ip, dom AS domain, risk_score FROM capped", _RESULTS))
def capped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service answers for its first fifty rows."""
    return api.analyze(unified(spark, sf_dir), *_dimensions(spark, sf_dir), quota=threat.REQUEST_QUOTA).results.select("event_id", "ip", "domain", "risk_score")


@query(with_view("SELECT count(*) AS results, count(*) FILTER (WHERE risk_score > 20) AS suspicious, (SELECT count(*) FROM (SELECT process_name FROM capped UNION SELECT ip FROM capped WHERE ip IS NOT NULL UNION SELECT dom FROM capped WHERE dom IS NOT NULL)) AS nodes, count(ip) + count(dom) AS edges FROM capped", _RESULTS))
def threat_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the document's parts, read back from its text."""
    made = json.loads(api.analyze(unified(spark, sf_dir), *_dimensions(spark, sf_dir), quota=threat.REQUEST_QUOTA).document())
    row = (len(made["results"]), made["summary"]["suspicious"], len(made["graph"]["nodes"]), len(made["graph"]["edges"]))
    return spark.createDataFrame([row], "results long, suspicious long, nodes long, edges long")


@query(with_view("SELECT event_id, ip, dom AS domain FROM tg ORDER BY md5(concat('1:', event_id)), event_id LIMIT 5", Q._TARGETS))
def drawn_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: five targets at random, the same ones every time."""
    return threat.drawn(threat.targets(unified(spark, sf_dir))).select("event_id", "ip", "domain")


@query(with_view("SELECT event_id, ip, dom AS domain FROM (SELECT *, row_number() OVER (PARTITION BY ip, dom ORDER BY us, event_id) AS rn FROM t0 WHERE ip IS NOT NULL OR dom IS NOT NULL) WHERE rn = 1", Q._TARGETS))
def distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5"""
    return threat.distinct_targets(threat.extracted(unified(spark, sf_dir))).select("event_id", "ip", "domain")


@query(with_view("SELECT n.host AS target, u.n FROM (SELECT domain AS host, count(*) AS n FROM u WHERE domain <> '' GROUP BY domain) n JOIN (SELECT domain AS host, count(*) AS n FROM u GROUP BY domain) u USING (host)"))
def uploaded_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded document of events, through the reader and the extraction."""
    path = table_path(spark, "upload") + ".json"
    events = unified(spark, sf_dir).where("domain <> ''").select(F.col("domain").alias("url"), "record_type")
    events.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("url", "record_type")).alias("events"))).alias("value")).write.text(path)
    return threat.extracted(readers.threat_events(spark, path)).groupBy(F.col("domain").alias("target")).agg(F.count("*").alias("n"))


@query(with_view("SELECT printf('CG-%016X', event_id) AS corr_id, 'CG-' || upper(substr(sha256(event_id::VARCHAR), 1, 32)) AS long_id FROM u"))
def correlation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of numbers and of texts."""
    ids = unified(spark, sf_dir).select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("text_id"))
    return ids.select(correlate.corr_id(ids, "event_id").alias("corr_id"), correlate.corr_id(ids, "text_id").alias("long_id"))


@query(Q._recursive((86400 + 1) * 1_000_000) + "SELECT event_id, nth FROM a WHERE nth = 1 OR nth <= 2 OR nth % 10 = 0")
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10"""
    made = stateful.dedup_decisions(unified(spark, sf_dir).select("event_id", "pid", "us"), ["pid"], 86400)
    return writers.console_lines(made).select("event_id", "nth")
