"""Exploration: schemas, null counts, sparsity, click distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import pin


def schema_table(df: DataFrame) -> DataFrame:
    """(column, dtype) of the table; as long as the schema, not as the data."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def null_counts_row(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of each column, in one pass."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def null_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, nulls), by default for the columns that have any."""
    names = df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in names])
    rows = null_counts_row(df).select(F.inline(pairs))
    return rows.where("nulls > 0") if only_missing else rows


def null_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, nulls): null cells of each table, one row per table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        counts = null_counts_row(df)
        total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in counts.columns])
        return counts.select(F.lit(name).alias("dataset"), total.alias("nulls"))

    return reduce(lambda a, b: a.unionByName(b), [one(name, df) for name, df in tables.items()])


def explore(df: DataFrame, rows: int = 5) -> dict[str, DataFrame]:
    """Schema, summary statistics, first rows and null counts as four lazy tables."""
    return {
        "schema": schema_table(df),
        "describe": df.summary(),
        "head": df.limit(rows),
        "null_counts": null_counts(df),
    }


def data_sparsity(behaviors: DataFrame) -> DataFrame:
    """One row (interactions, users, items, sparsity) over distinct user-article pairs.

    The log is read once: the distinct pairs are pinned, and users and items are counted
    from them as grouped rows, so no task holds a distinct set.
    """
    pairs = pin(behaviors.select("user_id", "article_id").distinct())
    n = pairs.agg(F.count("*")).scalar()
    users = pairs.select("user_id").dropna().distinct().agg(F.count("*")).scalar()
    items = pairs.select("article_id").dropna().distinct().agg(F.count("*")).scalar()
    cells = users.cast("double") * items.cast("double")
    one = behaviors.sparkSession.range(1)
    return one.select(
        n.alias("interactions"),
        users.alias("users"),
        items.alias("items"),
        (F.lit(1.0) - F.try_divide(n.cast("double"), cells)).alias("sparsity"),
    )


def article_clicks(behaviors: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, clicks) of the listed articles that were read.

    Clicks are counted per article before the join: the join then moves one row per
    article, and a hot article is folded on the map side.
    """
    counts = behaviors.groupBy("article_id").agg(F.count("user_id").alias("clicks"))
    return counts.join(articles.select("article_id"), "article_id")


def click_histogram(clicks: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, high, articles): equal-width bins between the extremes, empty ones included."""
    low = clicks.agg(F.min("clicks").cast("double")).scalar()
    high = clicks.agg(F.max("clicks").cast("double")).scalar()
    # A single value gets a bin range of half a unit on either side.
    flat = low == high
    start = F.when(flat, low - F.lit(0.5)).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low) / F.lit(float(bins))
    place = F.least(F.floor((F.col("clicks") - start) / width), F.lit(bins - 1)).cast("int")
    counted = clicks.groupBy(place.alias("bin")).agg(F.count("*").alias("articles"))
    numbers = clicks.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return numbers.join(counted, "bin", "left").select(
        "bin",
        (start + F.col("bin") * width).alias("low"),
        (start + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("articles", F.lit(0)).alias("articles"),
    )


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """(article_id, user_id, count) of the pairs with more than one row."""
    return df.groupBy("article_id", "user_id").agg(F.count("*").alias("count")).where("count > 1")
