"""Parquet in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A lazy table over ``path``; a path or schema that cannot be used raises ``ValueError``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as problem:
        raise ValueError(f"cannot read Parquet at {path}: {problem}") from problem


def write_parquet(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> DataFrame:
    """Write ``df`` and return the table read back from ``path``.

    With ``partition_by`` the rows are shuffled by those columns first, so each value
    is written by few tasks; AQE splits a value that holds much of the table.
    """
    writer = df.hint("rebalance", *partition_by).write if partition_by else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode(mode).parquet(path)
    return read_parquet(df.sparkSession, path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Save as a table at ``path``, bucketed and sorted by ``key``.

    Groups and joins on ``key``, and on ``key`` with more columns, need no exchange of a table with the same
    number of buckets. Rows are dealt by the key first, so that each bucket is one file.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
