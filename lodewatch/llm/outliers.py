"""Quality rules with robust multivariate outliers.

Fixed rules come first.  What passes them is judged within its language and
source by the minimum-covariance-determinant estimate of the group's transformed
statistics: the centre and covariance of those three quarters of the rows whose
covariance has the least determinant.  A row too far from it by Mahalanobis
distance is rejected.

The search starts from four scatter matrices that no small part of a group can
spoil: quartile ranges alone, the correlations of squashed values, the spatial
signs, and the rows near the medians.  Each is improved by concentration steps
(the nearest three quarters give the next estimate); the one of the least
determinant goes on until the determinant falls no more.

A step needs the count and moments of the nearest rows.  Distances are counted
in fine bins, and each bin's moments are summed in the same pass, so a step is
one aggregation whose result has a bounded number of rows per group, whatever
the group's size; no group is gathered anywhere.  Estimates reach the rows by
broadcast if all groups together are small, else by a join that deals each
group's rows in shares.  The bin at the edge is taken whole, so rows of equal
distance stay together.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.llm.common import group_key, written
from lodewatch.llm.textstats import STRETCH, text_counts

NAMES = ("x_word", "x_symbols", "x_lines", "x_repeats", "x_next", "x_distinct")
P = len(NAMES)
#: Least standard deviation of each statistic: a group in which one is nearly constant rejects nothing nearer.  Near the
#: spread of clean texts, and with REJECT such that each statistic can reject a text on its own.
FLOORS = (0.06, 0.3, 0.4, 0.55, 0.3, 0.02)
#: Share of a group that a step keeps; steps of every start, fall of the logarithm of a determinant that counts as one;
#: rows that the floors count as in a covariance.
COVERAGE, FIRST_STEPS, FALL, PRIOR_ROWS = 0.75, 2, 1e-3, 20.0
#: Chance of a Gaussian row to lie outside, when reweighting and when rejecting.
REWEIGHT, REJECT = 0.025, 1e-4
#: Bins per unit of a statistic, and per doubling of a squared distance.
FINE, DISTANCE_BINS = 64, 16
#: Bytes of all groups' estimates up to which they are broadcast; shares that a group's rows are dealt in beyond that.
BROADCAST_BYTES, SHARES = 8 << 20, 64
#: Moments of a set of rows: count, sums, products.
WIDTH = 1 + P + P * (P + 1) // 2


def tail(x: float, dof: int) -> float:
    """P(chi-squared > x), for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def quantile(p: float, dof: int) -> float:
    """Where the upper tail of chi-squared is p."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid, dof) > p else (low, mid)
    return high


#: Squared norm that half of Gaussian rows are within, and what their covariance is to be scaled by.
NEAR = quantile(0.5, P)
NEAR_FACTOR = 0.5 / (1 - tail(NEAR, P + 2))


def statistics() -> dict[str, Column]:
    """Smoothed, so that short texts don't scatter: shares are of some more words, characters or lines than there are.

    Distinct words are those of a stretch of the text, as a power of its words.
    """
    share = lambda part, whole, more: F.log1p(100.0 * F.col(part) / (F.col(whole) + more))
    stretch = F.least(F.col("n_words"), F.lit(STRETCH))
    return {
        "x_word": F.log((F.col("word_chars") + 250.0) / (F.col("n_words") + 50.0)),
        "x_symbols": share("n_symbols", "word_chars", 50.0),
        "x_lines": share("n_dup_lines", "n_words", 50.0),
        "x_repeats": share("n_repeat_words", "n_words", 50.0),
        "x_next": share("n_same_next", "n_words", 50.0),
        "x_distinct": F.log(50.0 + stretch * F.col("n_stretch_distinct") / F.greatest("n_words", F.lit(1))) / F.log(50.0 + stretch),
    }


def _distance() -> Column:
    """Squared, from the columns ``centre`` and ``inverse`` (row by row)."""
    gap = [F.col(n) - F.col("centre")[i] for i, n in enumerate(NAMES)]
    return sum((gap[i] * sum((F.col("inverse")[i * P + j] * gap[j] for j in range(P)), F.lit(0.0)) for i in range(P)), F.lit(0.0))


def _small(groups: DataFrame) -> bool:
    """Whether estimates of so many groups, of every start, may be broadcast."""
    starts, numbers = 4, P + P * P + 2 * P + 2
    size = groups.agg(F.sum(F.octet_length("g") + F.lit(8 * numbers))).first()[0]
    return starts * (size or 0) <= BROADCAST_BYTES


def _joined(rows: DataFrame, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Rows with what ``table`` has of their group, such that no group's rows meet in one task."""
    if small:
        return rows.join(F.broadcast(table), "g", how)
    dealt = rows.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)))
    each = table.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return dealt.join(each, ["g", "share"], how).drop("share")


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group, to the width of a bin: arrays ``mid`` and ``wide``."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.floor(F.col(n) * FINE).alias("bin")) for i, n in enumerate(NAMES))))
    bins = rows.select("g", each.alias("e")).groupBy("g", "e.k", "e.bin").agg(F.count("*").alias("n"))
    over = Window.partitionBy("g", "k")
    upto = F.sum("n").over(over.orderBy("bin"))
    at = bins.withColumns({"upto": upto, "total": F.sum("n").over(over)})
    level = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))
    found = at.groupBy("g", "k").agg(((level(0.5) + 0.5) / FINE).alias("mid"), ((level(0.75) - level(0.25)) / (1.349 * FINE)).alias("wide"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("k") + 1)
    by_group = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "mid", F.greatest("wide", floor).alias("wide")))).alias("s"))
    return by_group.select("g", F.col("s.mid").alias("mid"), F.col("s.wide").alias("wide"))


ESTIMATE = "struct<centre: array<double>, inverse: array<double>, logdet: double>"


def _covariances(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and covariance from rows of moments."""
    n = np.maximum(m[:, 0], 1.0)
    centre = m[:, 1 : P + 1] / n[:, None]
    second = np.zeros((len(m), P, P))
    for c, (i, j) in enumerate((i, j) for i in range(P) for j in range(i + 1)):
        second[:, i, j] = second[:, j, i] = m[:, P + 1 + c] / n
    return m[:, 0], centre, second - centre[:, :, None] * centre[:, None, :]


def _solved(n: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> pd.DataFrame:
    """Estimates from scatter matrices of so many rows, regularised: no statistic counts as narrower than its floor."""
    weight = (n / (n + PRIOR_ROWS))[:, None, None]
    spread = weight * spread + (1 - weight) * np.diag(np.square(FLOORS))
    spread[:, range(P), range(P)] += np.maximum(np.square(FLOORS) - np.einsum("kii->ki", spread), 0)
    return pd.DataFrame({"centre": list(centre), "inverse": list(np.linalg.inv(spread).reshape(len(spread), P * P)), "logdet": np.linalg.slogdet(spread)[1]})


def _stacked(moments: pd.Series) -> np.ndarray:
    return np.stack(moments.to_list()) if len(moments) else np.empty((0, WIDTH))


def _estimate(factor: float):
    """From the count and moments of a group's nearest rows: centre, inverse and determinant of the regularised covariance."""

    @F.pandas_udf(ESTIMATE)
    def solve(moments: pd.Series) -> pd.DataFrame:
        n, centre, spread = _covariances(_stacked(moments))
        return _solved(n, centre, factor * spread)

    return solve


def _first_estimate(start: int):
    """From the moments of a start's transformed rows, and the group's medians and widths."""

    @F.pandas_udf(ESTIMATE)
    def solve(moments: pd.Series, total: pd.Series, mid: pd.Series, wide: pd.Series) -> pd.DataFrame:
        n, mean, spread = _covariances(_stacked(moments))
        centre, scale = (np.stack(x.to_list()) if len(x) else np.empty((0, P)) for x in (mid, wide))
        own = np.einsum("kii->ki", spread)
        if start == 0:
            shape = np.broadcast_to(np.eye(P), spread.shape)
        elif start == 1:
            size = np.sqrt(np.maximum(own, 1e-12))
            shape = spread / (size[:, :, None] * size[:, None, :])
            shape[:, range(P), range(P)] = 1.0
        elif start == 2:
            shape = spread * (P / np.maximum(own.sum(axis=1), 1e-12))[:, None, None]
        else:
            shape = spread * NEAR_FACTOR
            centre = centre + mean * scale
        return _solved(total.to_numpy(float), centre, shape * (scale[:, :, None] * scale[:, None, :]))

    return solve


def _moments(columns: Sequence[Column]) -> list[Column]:
    return [F.count(columns[0]).cast("double"), *(F.coalesce(F.sum(c), F.lit(0.0)) for c in columns), *(F.coalesce(F.sum(columns[i] * columns[j]), F.lit(0.0)) for i in range(P) for j in range(i + 1))]


def _starts(rows: DataFrame, medians: DataFrame, small: bool) -> DataFrame:
    """Four estimates of each group, by ``start``."""
    z = [(F.col(n) - F.col("mid")[i]) / F.col("wide")[i] for i, n in enumerate(NAMES)]
    at = _joined(rows, medians, small).select("g", "mid", "wide", *(c.alias(f"z{i}") for i, c in enumerate(z)))
    z = [F.col(f"z{i}") for i in range(P)]
    at = at.withColumn("norm", sum((c * c for c in z), F.lit(0.0)))
    forms = [[F.tanh(c) for c in z], [F.coalesce(F.try_divide(c, F.sqrt("norm")), F.lit(0.0)) for c in z], [F.when(F.col("norm") <= NEAR, c) for c in z]]
    sums = at.groupBy("g", "mid", "wide").agg(F.count("*").alias("total"), *(c.alias(f"m{k}_{i}") for k, form in enumerate(forms) for i, c in enumerate(_moments(form))))
    moments = [F.array(*(f"m{k}_{i}" for i in range(WIDTH))) for k in range(len(forms))]
    made = [F.struct(F.lit(s).alias("start"), _first_estimate(s)(moments[max(s - 1, 0)], "total", "mid", "wide").alias("e")) for s in range(4)]
    return sums.select("g", F.explode(F.array(*made)).alias("x")).select("g", "x.start", "x.e.*")


def _refined(rows: DataFrame, estimate: DataFrame, small: bool, nearest: bool) -> DataFrame:
    """A step: each estimate from the rows nearest to the last one, or within the reweighting distance of it."""
    far = _joined(rows, estimate.select("g", "start", "centre", "inverse"), small).withColumn("far", _distance())
    names = [F.col(n) for n in NAMES]
    if nearest:
        share, cut = COVERAGE, quantile(1 - COVERAGE, P)
        bins = far.groupBy("g", "start", F.floor(DISTANCE_BINS * F.log2(1.0 + F.greatest("far", F.lit(0.0)))).alias("bin")).agg(*(c.alias(f"m{i}") for i, c in enumerate(_moments(names))))
        over = Window.partitionBy("g", "start")
        before = F.coalesce(F.sum("m0").over(over.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        bins = bins.withColumns({"before": before, "total": F.sum("m0").over(over)}).where(F.col("before") < F.ceil(COVERAGE * F.col("total")))
        sums = bins.groupBy("g", "start").agg(*(F.sum(f"m{i}").alias(f"m{i}") for i in range(WIDTH)))
    else:
        cut = quantile(REWEIGHT, P)
        share = 1 - REWEIGHT
        sums = far.where(F.col("far") <= cut).groupBy("g", "start").agg(*(c.alias(f"m{i}") for i, c in enumerate(_moments(names))))
    factor = share / (1 - tail(cut, P + 2))
    return sums.select("g", "start", _estimate(factor)(F.array(*(f"m{i}" for i in range(WIDTH)))).alias("e")).select("g", "start", "e.*")


def estimates(rows: DataFrame) -> DataFrame:
    """``centre``, ``inverse`` and ``logdet`` of the minimum-covariance-determinant estimate of each group ``g`` of rows of statistics."""
    medians = written(_medians(rows), "medians")
    small = _small(medians)
    found = written(_starts(rows, medians, small), "estimate")
    for _ in range(FIRST_STEPS):
        found = written(_refined(rows, found, small, True), "estimate")
    best = found.groupBy("g").agg(F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("e"))
    # A group whose determinant falls no more keeps its estimate, and only the others' rows go into another step.
    # Each fall is of FALL at least, and the floors bound the determinant from below, so there is a last one.
    active, done = written(best.select("g", "e.*"), "estimate"), []
    while True:
        later = _refined(rows, active, small, True).select("g", F.struct("start", "centre", "inverse", "logdet").alias("new"))
        falls = F.col("new.logdet") < F.col("logdet") - FALL
        now = active.join(later, "g", "left").withColumn("falls", F.coalesce(falls, F.lit(False)))
        kept = [F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("start", "centre", "inverse", "logdet")]
        stepped = written(now.select("g", *kept, "falls"), "estimate")
        done.append(stepped.where("not falls").drop("falls"))
        active = stepped.where("falls").drop("falls")
        if active.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Judges every whole text by fixed rules and by its distance within its language and source.

    Returns, a row for each row: the id, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``distance`` (Mahalanobis; null if base_failed) and ``kept``.  Null and
    empty texts have no words and fail the rules.  A null language or source is
    a group of its own.  A row that is alone in its group is kept, and in a
    small group the floors stand for the spread that it can't show.  Rows of one
    id are judged one by one; an empty table gives an empty table; other columns
    are ignored.
    """
    # As lists, so that no two different pairs are one group.
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.to_json(F.array(group_key(lang_col), group_key(source_col))).alias("g"))
    counted = text_counts(texts, variety=True)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = written(counted.withColumn("base_failed", failed), "counts").withColumns(statistics())
    # The statistics are made once, and each step reads six numbers a row.
    rows = written(judged.where(~F.col("base_failed")).select("g", *NAMES), "statistics")
    found = estimates(rows)
    small = _small(found)
    # A group none of whose rows is near its centre keeps the estimate as it is.
    again = _refined(rows, found, small, False).select("g", F.struct("centre", "inverse").alias("e"))
    estimate = written(found.join(again, "g", "left").select("g", F.coalesce("e", F.struct("centre", "inverse")).alias("e")).select("g", "e.centre", "e.inverse"), "estimate")
    out = _joined(judged, estimate, small, "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(_distance(), F.lit(0.0)))))
    kept = ~F.col("base_failed") & (F.col("distance") <= math.sqrt(quantile(REJECT, P)))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
