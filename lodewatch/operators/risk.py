"""Features of groups, and a model of their risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.shared import table_path

#: What a group's vector holds, in order.
FEATURES = ("log_occurrences", "log_actions", "log_seconds", "n_processes", "n_addresses", "n_users", "n_files", "has_script", "has_process", "has_network")


def with_features(groups: DataFrame) -> DataFrame:
    """Adds the features of ``correlate.assemble``'s groups, as numbers; what is missing counts 0."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("double")
    log = lambda c: F.log1p(F.coalesce(c.cast("double"), F.lit(0.0)))
    has = lambda t: F.coalesce(F.array_contains("record_types", t), F.lit(False)).cast("double")
    seconds = (F.col("end_us") - F.col("start_us")) / 1_000_000
    values = (log(F.col("total_occurrences")), log(F.col("unique_events")), log(seconds), size("processes"), size("dest_ips"), size("users"), size("source_files"), has("script_execution"), has("process_start"), has("network_connect"))
    return groups.withColumns(dict(zip(FEATURES, values, strict=True)))


@dataclass(frozen=True)
class Model:
    """A fitted pipeline: scaled features and a logistic regression."""

    fitted: PipelineModel
    threshold: float = 0.5

    @classmethod
    def trained(cls, groups: DataFrame, label: str, threshold: float = 0.5, penalty: float = 0.01) -> Model:
        """From groups with a boolean ``label``, of which null ones are left out."""
        rows = with_features(groups).where(F.col(label).isNotNull()).withColumn("label_", F.col(label).cast("double"))
        steps = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw_"), StandardScaler(inputCol="raw_", outputCol="scaled_", withMean=True), LogisticRegression(featuresCol="scaled_", labelCol="label_", predictionCol="predicted_", probabilityCol="chance_", rawPredictionCol="margin_", regParam=penalty)]
        fitted = Pipeline(stages=steps).fit(rows.select("label_", *FEATURES))
        # What is read again has no summary of the training, which can't go to executors.
        path = table_path(groups.sparkSession, "model")
        fitted.write().save(path)
        return cls.load(path, threshold)

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, threshold: float = 0.5) -> Model:
        return cls(PipelineModel.load(path), threshold)

    def scored(self, groups: DataFrame) -> DataFrame:
        """Adds ``risk_score``, the chance of the label."""
        out = self.fitted.transform(with_features(groups))
        return out.withColumn("risk_score", vector_to_array("chance_")[1]).select(*groups.columns, "risk_score")

    def score(self) -> Column:
        """The same chance in plain arithmetic over ``with_features``: the pipeline's numbers, without its steps."""
        _, scaler, regression = self.fitted.stages
        weights = [w / s if s else 0.0 for w, s in zip(regression.coefficients.toArray().tolist(), scaler.std.toArray().tolist(), strict=True)]
        margin = sum((F.col(n) * w for n, w in zip(FEATURES, weights, strict=True)), F.lit(float(regression.intercept) - sum(w * m for w, m in zip(weights, scaler.mean.toArray().tolist(), strict=True))))
        return 1 / (1 + F.exp(-margin))

    def threat(self, groups: DataFrame) -> Column:
        """For ``enrich.verdicts``, over groups that have their features."""
        missing = set(FEATURES) - set(groups.columns)
        if missing:
            raise ValueError(f"add the features first: {sorted(missing)}")
        return self.score() >= self.threshold
