"""Queries with tables of patterns, roots and networks in place of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.operators import patterns, prefixes
from lodewatch.plans.registry import query
from lodewatch.plans.views import table

_PATTERNS = """pats AS (SELECT i * 3 AS id, lower(substring(text, 1 + i % 5, 4 + i % 4)) AS pattern, concat('C', i % 7) AS category, i % 5 + 1 AS severity FROM (SELECT item_id AS i, text FROM benchmark)
  UNION ALL SELECT doc_id * 3 + 1, lower(substring(text, 10, 9)), concat('D', doc_id % 3), doc_id % 5 + 1 FROM documents WHERE doc_id % 3 = 0 AND length(text) > 20),
hits AS (SELECT doc_id, id, category, severity FROM documents JOIN pats ON contains(lower(text), pattern))"""


def _table_of_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ones from the benchmark, and one from each third document."""
    i = F.col("item_id")
    short = table(spark, sf_dir, "benchmark").select((i * 3).alias("id"), F.substring("text", (1 + i % 5).cast("int"), (4 + i % 4).cast("int")).alias("pattern"), F.concat(F.lit("C"), i % 7).alias("category"), (i % 5 + 1).alias("severity"))
    d = F.col("doc_id")
    long = table(spark, sf_dir, "documents").where((d % 3 == 0) & (F.length("text") > 20)).select((d * 3 + 1).alias("id"), F.substring("text", 10, 9).alias("pattern"), F.concat(F.lit("D"), d % 3).alias("category"), (d % 5 + 1).alias("severity"))
    return short.unionByName(long)


@query(f"WITH {_PATTERNS} SELECT d.doc_id, (SELECT count(*) FROM hits h WHERE h.doc_id = d.doc_id)::INT AS pattern_hits FROM documents d")
def pattern_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many patterns of a table each document holds."""
    return patterns.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), _table_of_patterns(spark, sf_dir), F.col("text"), keep=("doc_id",)).select("doc_id", "pattern_hits")


@query(f"WITH {_PATTERNS} SELECT d.doc_id, severity::INT AS severity, category FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, id) AS rn FROM hits) h ON h.doc_id = d.doc_id AND rn = 1")
def pattern_table_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severest pattern of a table."""
    found = patterns.severest(table(spark, sf_dir, "documents").select("doc_id", "text"), _table_of_patterns(spark, sf_dir), F.col("text"), keep=("doc_id",))
    return found.select("doc_id", "match.severity", "match.category")


@query("""WITH roots AS (SELECT lower(substring(url, 1, 8 + page_id % 30)) AS prefix, min(concat('T', page_id % 9)) AS trust FROM pages WHERE page_id % 4 = 0 GROUP BY 1)
SELECT p.page_id, coalesce(arg_max(trust, length(prefix)), 'UNKNOWN') AS location FROM pages p LEFT JOIN roots ON starts_with(lower(url), prefix) GROUP BY p.page_id""")
def root_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of a table's roots."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    roots = pages.where(i % 4 == 0).select(F.substring("url", F.lit(1), (8 + i % 30).cast("int")).alias("prefix"), F.concat(F.lit("T"), i % 9).alias("trust"))
    return prefixes.longest_root(pages, "url", roots).select("page_id", "location")


_A = "((user_id * 2654435761) % 4294967296)"
_NETS = f"SELECT DISTINCT event_id % 33 AS bits, (a >> (32 - event_id % 33)::INT) AS top FROM (SELECT event_id, {_A} AS a FROM events WHERE event_id % 5 = 0)"


@query(f"""WITH nets AS ({_NETS}), e AS (SELECT event_id, {_A} AS a FROM events)
SELECT event_id, max(bits)::INT AS bits FROM e LEFT JOIN nets ON (a >> (32 - bits)::INT) = top GROUP BY event_id""")
def network_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 with a table: the smallest of many networks around an address."""
    a = F.col("user_id") * 2654435761 % 4294967296
    dotted = F.concat_ws(".", *(F.shiftright(a, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    events = table(spark, sf_dir, "events").select("event_id", dotted.alias("ip"))
    nets = events.where("event_id % 5 = 0").select(F.concat("ip", F.lit("/"), F.col("event_id") % 33).alias("network"), F.lpad((F.col("event_id") % 33).cast("string"), 2, "0").alias("label"))
    return prefixes.longest_network(events, "ip", nets).select("event_id", F.col("network_label").cast("int").alias("bits"))
