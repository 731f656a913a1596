"""The corpus pipeline: five stages over documents, each of which rereads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.llm.common import scratch, written
from lodewatch.llm.minhash import near_duplicates
from lodewatch.llm.outliers import quality_rules
from lodewatch.llm.packing import pack
from lodewatch.llm.quality import quality
from lodewatch.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with the number ``row``, so that verdicts are of rows also where ids repeat or are missing."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select("row"), "row", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    with scratch(spark, docs):
        docs = _numbered(docs)
        return _only(docs, quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",)).where("predicted = 1"))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers of their language and source."""
    with scratch(spark, docs):
        docs = _numbered(docs)
        return _only(docs, quality_rules(docs, id_col="row").where("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, and of what stays one row of each id.

    Rows are linked by their texts, also those without an id, which come last in their group.
    """
    with scratch(spark, docs):
        docs = _numbered(docs)
        groups = near_duplicates(docs, percent=80, words=5, id_col="row").select("row", "component_id").join(docs.select("row", "doc_id"), "row")
        first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.*")
        return _only(docs, first.groupBy("doc_id", F.when(F.col("none"), F.col("row"))).agg(F.min("row").alias("row")))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeat an earlier one; texts that lose none stay as they are."""
    with scratch(spark, docs):
        out = substring_dedup(docs.select(*COLUMNS), words=13, carry=("lang", "source", "n_chars"), verbatim=True)
        n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their identifiers."""
    with scratch(spark, docs):
        return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: Scores, robust estimates and token identifiers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
