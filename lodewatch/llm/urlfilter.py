"""URL filters: explicit rules, then association rules that Spark's FP-growth mines from labels.

Everything is DataFrame functions and Spark's own FP-growth, without Python on
the executors.  Rules are pruned by support, by confidence, and by what chance
alone would give: where labels have nothing to do with URLs, no rule is left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.common import written

#: The item that marks a transaction as labelled bad; no token has its first character.
BAD = "\x01bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Share of labelled URLs that a mined combination needs, the least number of them, and its confidence.
SUPPORT, LEAST_COUNT, CONFIDENCE = 0.002, 5, 0.5
#: Chance that any rule is kept although URLs tell nothing about labels.
ALPHA = 0.05
#: Tokens in a rule, and frequent tokens of a URL beyond which combinations of the others are counted by joins and not by FP-growth.
MOST_TOKENS, MOST_ITEMS = 3, 12


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct of ``rule`` and ``verdict``, else null; rules are (``host/path``, verdict)."""
    fits = []
    for rule, verdict in rules:
        own, slash, rest = rule.partition("/")
        match = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        fits.append(F.when(match, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, and words of the path with numbers made alike."""
    hosts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(hosts, words), lambda x: F.length(x) > 2)))


def _telling(confidence: Column, n: Column, base: float, tests: int, alpha: float) -> Column:
    """Whether so high a share of bad among n has, at the base rate, a chance under alpha for all tests together (Chernoff's bound)."""
    term = lambda p, q: F.when(p > 0, p * F.log(p / F.lit(q))).otherwise(0.0)
    if not 0 < base < 1:
        return F.lit(False)
    return (confidence > base) & (n * (term(confidence, base) + term(1 - confidence, 1 - base)) >= math.log(max(tests, 1) / alpha))


RULES = "tokens array<string>, confidence double, n_bad long, anchor string"
CLASSES = "token string, rep string"


def _with_common(tok: DataFrame, common: DataFrame, least: int, most_tokens: int) -> DataFrame:
    """All pairs and triples of tokens of which one is common, that ``least`` bad URLs have: ``tokens``, ``confidence``, ``n_bad``.

    tok: ``row``, ``bad``, ``token``.  A combination is made once in each row,
    from its first common token.  A triple's pairs with that token are
    frequent themselves, so triples come from these alone.
    """
    marked = tok.join(common.withColumn("common", F.lit(True)), "token", "left").select("row", "bad", "token", F.coalesce("common", F.lit(False)).alias("common"))
    one = marked.where("common").select("row", "bad", F.col("token").alias("a"))
    pairs = one.join(marked.select("row", F.col("token").alias("b"), F.col("common").alias("common_b")), "row").where("a <> b and (not common_b or a < b)").select("row", "bad", "a", "b")
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad")).where(F.col("n_bad") >= least)
    often = written(count(pairs, "a", "b"), "pairs")
    rule = lambda df, *by: df.select(F.array_sort(F.array(*by)).alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), "n_bad")
    if most_tokens < 3:
        return rule(often, "a", "b")
    own = written(pairs.join(often.select("a", "b"), ["a", "b"]), "row-pairs")
    triples = own.join(own.select("row", "a", F.col("b").alias("c")), ["row", "a"]).where("b < c")
    return written(rule(often, "a", "b").unionByName(rule(count(triples, "a", "b", "c"), "a", "b", "c")), "combinations")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, alpha: float = ALPHA, most_tokens: int = MOST_TOKENS, most_items: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Token combinations that tell bad URLs (``tokens``, ``confidence``, ``n_bad``, ``anchor``: the rarest token), and the tokens' classes.

    labelled: ``row`` (a number of its own), ``tokens`` and ``bad`` (boolean).
    Tokens that the same labelled URLs have can't be told apart, so they are a
    class, and rules are made of the smallest of each (``rep``), of
    ``most_tokens`` (3 or fewer) at most.  Spark's FP-growth mines combinations
    of the support.  It makes combinations of any size, so tokens that some URL
    has beyond its rarest ``most_items`` are left out there, and all
    combinations with one of these are counted by joins, pairs before
    triples: see ``_with_common``.  No token and no combination is dropped.  Single tokens of less support are counted exactly
    and need LEAST_COUNT bad URLs in any table, however large.  A rule stays if
    more than ``confidence`` of its URLs are bad and that is no chance: under
    the base rate, all candidates counted, no rule at all would stay with
    probability 1 - alpha.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], RULES), spark.createDataFrame([], CLASSES)
    rows = written(labelled.where(F.size("tokens") > 0), "labelled")
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not n_bad:
        return none
    base, least = n_bad / n, max(LEAST_COUNT, math.ceil(support * n))
    each = rows.select("row", F.col("bad").cast("long").alias("bad"), F.explode("tokens").alias("token"))
    sign = [F.expr(f"bit_xor(xxhash64({seed}, row))").alias(f"s{seed}") for seed in (1, 2)]
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"), *sign).where(F.col("n_bad") >= LEAST_COUNT)
    classes = written(counts.join(counts.groupBy("n", "s1", "s2").agg(F.min("token").alias("rep")), ["n", "s1", "s2"]).select("token", "rep", "n", "n_bad"), "classes")
    reps = classes.where("token = rep")
    frequent = reps.where(F.col("n_bad") >= least).select("token", F.col("n").alias("size"))
    # By row: tokens from the rarest on; those beyond the bound are common ones, in all rows.
    tok = written(each.join(frequent, "token").select("row", "bad", "token", "size"), "tokens")
    by_size = F.transform(F.array_sort(F.collect_list(F.struct("size", "token"))), lambda x: x["token"])
    beyond = tok.groupBy("row").agg(by_size.alias("items")).where(F.size("items") > most_items)
    common = written(beyond.select(F.explode(F.slice("items", F.lit(most_items + 1), F.size("items"))).alias("token")).distinct(), "common")
    baskets = tok.join(common, "token", "left_anti").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    baskets = written(baskets.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "baskets")
    n_baskets = baskets.count()
    mined = _with_common(tok, common, least, most_tokens) if most_tokens > 1 and not common.isEmpty() else none[0].drop("anchor")
    tests = mined.count()
    if n_baskets:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_baskets), minConfidence=confidence).fit(baskets)
        size = F.size("items")
        tests += model.freqItemsets.where(F.array_contains("items", BAD) & (size > 2) & (size <= most_tokens + 1)).count()
        several = F.size("antecedent").between(2, most_tokens)
        found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("consequent") == 1) & several)
        mined = mined.unionByName(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * n_baskets).cast("long").alias("n_bad")))
    single = reps.select(F.array("token").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), "n_bad")
    tests += reps.count()
    kept = mined.unionByName(single).where((F.col("confidence") > confidence) & _telling(F.col("confidence"), F.col("n_bad") / F.col("confidence"), base, tests, alpha))
    anchored = kept.withColumn("token", F.explode("tokens")).join(reps.select("token", "n"), "token")
    anchored = anchored.groupBy("tokens", "confidence", "n_bad").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    return anchored, classes.select("token", "rep")


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Judges every URL: by the longest explicit rule that fits, else ``block`` if a mined rule matches, else ``allow``.

    labels: ``page_id`` (or ``id_col``) and ``bad``; null labels are left out,
    and a page labelled several times is as many labelled URLs.  Returns the
    id, ``host``, ``path``, ``rule`` (null: none fits) and ``verdict``, a row
    for each row.  A null or malformed URL has empty host, path and tokens, and
    is allowed.  Repeated rows and null ids are judged like any other; without
    labels, or where no rule is more than chance, nothing is mined; an empty
    table gives an empty table; other columns are ignored.
    """
    host, path = parsed(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    split = split.withColumns({"tokens": tokens(F.col("host"), F.col("path")), "ruled": ruled(F.col("host"), F.col("path"), rules)})
    split = written(split, "urls")
    labelled = split.join(labels.select(F.col(id_col).alias("id"), "bad").where("bad is not null"), "id").select(F.monotonically_increasing_id().alias("row"), "tokens", "bad")
    mined, classes = mined_rules(labelled, support, confidence)
    mined = written(mined, "rules")
    # Token sets repeat far more than URLs: each is looked up once, by the classes of its tokens, under its rules' anchors.
    used = classes.join(mined.select(F.explode("tokens").alias("rep")).distinct(), "rep")
    sets = split.where("ruled is null").select("tokens").distinct()
    own = sets.withColumn("token", F.explode("tokens")).join(used, "token").groupBy("tokens").agg(F.collect_set("rep").alias("reps"))
    hits = own.withColumn("anchor", F.explode("reps")).join(mined.select(F.col("tokens").alias("needed"), "anchor"), "anchor")
    hits = hits.where(F.size(F.array_except("needed", "reps")) == 0).select("tokens").distinct().withColumn("hit", F.lit(True))
    # Written, its size is known: small, it is broadcast; large, both sides of the join can be split where a token set is hot.
    hits = written(hits, "hits")
    out = split.join(hits, "tokens", "left")
    verdict = F.coalesce("ruled.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"))
