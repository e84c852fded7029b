"""The standard set of tables under one root folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.parquet import read_parquet
from newsloom.sources.schemas import ARTICLES, BEHAVIORS, DOCUMENT_VECTOR, HISTORY

# Fixed places of the tables below the root folder.
ARTICLES_FILE = "articles.parquet"
VECTORS_FILE = "document_vector.parquet"
TRAIN_FILE = "train/behaviors.parquet"
VALIDATION_FILE = "validation/behaviors.parquet"
TRAIN_HISTORY_FILE = "train/history.parquet"


@dataclass(frozen=True)
class Dataset:
    """Lazy tables; nothing is read until an operator's result is asked for."""

    articles: DataFrame
    document_vectors: DataFrame
    train_behaviors: DataFrame
    validation_behaviors: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, root: str, declared: bool = False) -> "Dataset":
        """Read the set; with ``declared`` the schemas are imposed, else taken from the files."""

        def table(name: str, schema):
            return read_parquet(spark, f"{root.rstrip('/')}/{name}", schema if declared else None)

        return cls(
            articles=table(ARTICLES_FILE, ARTICLES),
            document_vectors=table(VECTORS_FILE, DOCUMENT_VECTOR),
            train_behaviors=table(TRAIN_FILE, BEHAVIORS),
            validation_behaviors=table(VALIDATION_FILE, BEHAVIORS),
        )

    @staticmethod
    def history(spark: SparkSession, root: str, declared: bool = False) -> DataFrame:
        """Click history with its two parallel list columns."""
        return read_parquet(spark, f"{root.rstrip('/')}/{TRAIN_HISTORY_FILE}", HISTORY if declared else None)
