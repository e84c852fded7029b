"""Cleaning of the impression log and of the standard table set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.reshape import one_hot
from newsloom.sources.dataset import Dataset
from newsloom.sources.schemas import require_columns

# Fixed column lists of the standard cleaning.
ARTICLE_UNUSED = ["total_inviews", "total_pageviews", "total_read_time", "image_ids"]
BEHAVIOR_SPARSE = ["gender", "postcode", "age"]
BEHAVIOR_FUTURE = ["next_read_time", "next_scroll_percentage", "article_ids_inview", "article_ids_clicked"]
BEHAVIOR_CONTEXT = ["is_sso_user", "is_subscriber", "session_id", "device_type", "impression_time"]
RELEVANT_COLUMNS = ["impression_id", "article_id", "impression_time", "user_id"]


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column mean, which Spark computes once as a scalar subquery."""
    means = {c: df.agg(F.avg(c)).scalar() for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), mean) for c, mean in means.items()})


def clean_table(
    df: DataFrame,
    remove_columns: list[str] | None = None,
    filter_null_columns: list[str] | None = None,
    expand_columns: dict[str, list] | None = None,
    predict_columns: list[str] | None = None,
    predict_strategy: str = "mean",
    sort_by: str | None = None,
) -> DataFrame:
    """Drop columns, drop rows with a null in any listed column, then the optional steps.

    ``expand_columns`` maps a column to the values that get a 0/1 column each.
    ``sort_by`` sorts descending with nulls first; consumers should not rely on row
    order after a later shuffle.
    """
    if remove_columns:
        require_columns(df, remove_columns)
        df = df.drop(*remove_columns)
    if filter_null_columns:
        df = df.dropna("any", subset=filter_null_columns)
    if predict_columns:
        if predict_strategy != "mean":
            raise ValueError(f"unknown strategy {predict_strategy!r}; only 'mean' is known")
        df = fill_with_mean(df, predict_columns)
    for column, values in (expand_columns or {}).items():
        df = one_hot(df, column, values)
    return df.orderBy(F.col(sort_by).desc_nulls_first()) if sort_by else df


def clean_train_and_validation(train: DataFrame, validation: DataFrame, **options) -> DataFrame:
    """The same cleaning on both parts, stacked by column name."""
    return clean_table(train, **options).unionByName(clean_table(validation, **options))


def clean_standard_set(data: Dataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, document vectors, behaviors) of the standard set."""
    articles = clean_table(data.articles, remove_columns=ARTICLE_UNUSED, sort_by="published_time")
    behaviors = clean_train_and_validation(
        data.train_behaviors,
        data.validation_behaviors,
        remove_columns=BEHAVIOR_SPARSE + BEHAVIOR_FUTURE,
        filter_null_columns=["article_id"],
    )
    return articles, data.document_vectors, behaviors


def reduce_behaviors(
    train: DataFrame, validation: DataFrame, relevant_columns: list[str] | None = None
) -> DataFrame:
    """Both parts cut to the columns the baselines read, home-page rows dropped.

    The result carries no order: every consumer sorts or ranks by time itself, so a
    sort here would be a wasted shuffle of the whole log.
    """
    columns = relevant_columns or RELEVANT_COLUMNS
    return (
        train.select(columns)
        .unionByName(validation.select(columns))
        .where(F.col("article_id").isNotNull())
    )


def known_pairs(df: DataFrame) -> DataFrame:
    """Distinct (user_id, article_id) of rows that name both."""
    pairs = df.select(F.col("user_id").cast("long").alias("user_id"), F.col("article_id").cast("long").alias("article_id"))
    return pairs.dropna().distinct()


def drop_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are neither null nor NaN."""
    floating = {name for name, kind in df.dtypes if kind in ("float", "double")}
    for key in keys:
        df = df.where(F.col(key).isNotNull())
        if key in floating:
            df = df.where(~F.isnan(key))
    return df


def prefix_columns(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Every column outside ``keep`` renamed with ``prefix``."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
