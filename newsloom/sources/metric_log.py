"""Append-only table of model metrics: one row per (model, metric)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.schemas import METRICS

# Fixed metric names.
RANKING_METRICS = ["precision@k", "recall@k", "fpr@k"]
COVERAGE_METRIC = "aggregate_diversity"
GINI_METRIC = "gini_coefficient"


class MetricLog:
    """Each append adds files; rows already written are never touched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _append(self, model: str, values: dict[str, float | None]) -> None:
        rows = self.spark.createDataFrame([(model, name, value) for name, value in values.items()], METRICS)
        rows.withColumn("value", F.coalesce("value", F.lit(0.0))).coalesce(1).write.mode("append").parquet(self.path)

    def append_ranking(self, model: str, metrics: dict[str, float]) -> None:
        """Precision, recall and false-positive rate; a missing one is stored as 0."""
        self._append(model, {name: metrics.get(name) for name in RANKING_METRICS})

    def append_coverage(self, model: str, value: float) -> None:
        self._append(model, {COVERAGE_METRIC: value})

    def append_gini(self, model: str, value: float) -> None:
        self._append(model, {GINI_METRIC: value})

    def append_frame(self, metrics: DataFrame) -> None:
        """Append metrics that are already rows (model, metric, value), without collecting them."""
        metrics.select(
            "model", "metric", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")
        ).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(METRICS).parquet(self.path)
