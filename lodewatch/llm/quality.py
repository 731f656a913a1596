"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the diagonal of the
pooled one.  Its Cholesky factor is found once and kept in the model; a score
is the logistic of the difference of the two log densities, whose Mahalanobis
terms come from the inverse factor by plain column arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.llm.common import written
from lodewatch.llm.textstats import text_counts

#: Weight of the pooled diagonal in a class covariance, and the least variance.
SHRINKAGE, LEAST_VARIANCE = 0.1, 1e-3


#: Ordinary words, characters and lines that each text is thought to have besides its own, so that short texts don't scatter.
WORDS, CHARS, LINES = 30.0, 180.0, 3.0


def statistics() -> dict[str, Column]:
    """The transformed statistics, of the counts of one text."""
    share = lambda part, whole, more: F.log1p(100.0 * F.col(part) / (F.col(whole) + more))
    return {
        "x_word": F.log((F.col("word_chars") + 5.0 * WORDS) / (F.col("n_words") + WORDS)),
        "x_symbols": share("n_symbols", "n_chars", CHARS),
        "x_repeats": share("n_repeat_words", "n_words", WORDS),
        "x_same": share("n_same_next", "n_words", WORDS),
        "x_upper": share("n_upper", "n_chars", CHARS),
        "x_exclaim": share("n_exclaim", "n_words", WORDS),
        "x_distinct": (F.col("n_distinct") + 0.8 * WORDS) / (F.col("n_words") + WORDS),
        "x_lines": share("n_dup_lines", "n_lines", LINES),
        "x_punct": share("n_punct", "n_chars", CHARS),
    }


@dataclass(frozen=True)
class Discriminant:
    """By class (0, 1): mean, inverse Cholesky factor of the covariance, log determinant, log prior.

    Without rows of both classes there are no densities, and every score is ``share``.
    """

    names: tuple[str, ...]
    share: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    constants: tuple[float, float] = (0.0, 0.0)

    def _log_density(self, k: int) -> Column:
        far = F.lit(self.constants[k])
        for i, row in enumerate(self.factors[k]):
            term = sum((F.lit(float(row[j])) * (F.col(self.names[j]) - F.lit(float(self.means[k][j]))) for j in range(i + 1)), F.lit(0.0))
            far = far - 0.5 * term * term
        return far

    def score(self) -> Column:
        """Probability of class 1, from the columns ``names``."""
        if self.means is None:
            return F.lit(self.share)
        return 1.0 / (1.0 + F.exp(F.least(self._log_density(0) - self._log_density(1), F.lit(700.0))))


def fit(rows: DataFrame, label: str, names: list[str]) -> Discriminant:
    """Fits on all rows whose ``label`` is 0 or 1, by one aggregation of moments of a fixed size."""
    p = len(names)
    sums = [F.sum(n) for n in names] + [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(p) for j in range(i + 1)]
    found = {r[0]: np.array(r[1:], float) for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*"), *sums).collect()}
    n = {k: found[k][0] if k in found else 0.0 for k in (0, 1)}
    total = n[0] + n[1]
    if not n[0] or not n[1]:
        return Discriminant(tuple(names), n[1] / total if total else 0.5)
    means, covariances = [], []
    for k in (0, 1):
        mean = found[k][1 : p + 1] / n[k]
        second = np.zeros((p, p))
        second[np.tril_indices(p)] = found[k][p + 1 :] / n[k]
        second += np.tril(second, -1).T
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    pooled = sum(n[k] * np.diag(covariances[k]) for k in (0, 1)) / total
    target = np.diag(np.maximum(pooled, LEAST_VARIANCE))
    factors, constants = [], []
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - SHRINKAGE) * covariances[k] + SHRINKAGE * target)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n[k] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(names), n[1] / total, tuple(means), tuple(factors), tuple(constants))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a missing id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality(df: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, carry: Sequence[str] = ()) -> DataFrame:
    """Scores every whole text; learns from the labels of rows that are not held out.

    Returns the id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier)
    and ``predicted`` (1 if score >= threshold), a row for each row.  Null and
    empty texts are scored like a text without words; null labels and labels
    without a row are left out; a row labelled twice counts twice; with labels
    of one class only, each score is the share of label 1 (0.5 without any).  An
    empty table gives an empty table; other columns are ignored, but for those
    of ``carry``, which come last.
    """
    columns = statistics()
    carried = [f"c{i}" for i in range(len(carry))]
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    counts = written(text_counts(texts, more=True), "statistics").select("id", *carried, *(c.alias(n) for n, c in columns.items()))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label")).where(~held_out("id"))
    model = fit(counts.join(known, "id"), "label", list(columns))
    scored = counts.select("id", *carried, held_out("id").alias("held_out"), model.score().alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)))
