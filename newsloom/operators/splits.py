"""Train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import truncated_share, unit_hash
from newsloom.operators.ranking import HOT_GROUP_ROWS, nth_smallest, rank_within, time_stats


def random_split(
    df: DataFrame, test_ratio: float = 0.30, key: str = "impression_id", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(train, test): each row falls by a hash of its key.

    A function of the row alone, so a recomputed partition gives the same split and
    the parts are disjoint and complete; no shuffle. Rows without a key are train rows.
    """
    is_test = F.coalesce(unit_hash(F.col(key) + F.lit(seed)) < F.lit(float(test_ratio)), F.lit(False))
    return df.where(~is_test), df.where(is_test)


def pair_key(first: str, second: str) -> Column:
    """A non-negative key for rows identified by two ids."""
    return F.pmod(F.xxhash64(first, second), F.lit(2**31))


def time_split(
    df: DataFrame,
    time_field: str = "impression_time",
    id_field: str = "impression_id",
    test_ratio: float = 0.30,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the oldest share of rows by (time, id) is the test part.

    Only the boundary row is searched for; both parts are then plain filters. A missing time
    is older than any other, and so is a missing id among rows of one time; rows that have neither
    can't be told apart and fall together.
    """
    stats = df.agg(F.count("*").alias("rows"), F.min(id_field).alias("least"), *time_stats(F.col(time_field))).first()
    rows, timed, least = stats["rows"], stats["timed"], stats["least"]
    n_test = int(rows * test_ratio)
    if n_test == 0:
        return df, df.where(F.lit(False))
    time, item = F.col(time_field), F.coalesce(F.col(id_field), F.lit((0 if least is None else least) - 1))
    kind = dict(df.dtypes)[time_field]
    if n_test > rows - timed:
        keys = df.where(time.isNotNull()).select(time.alias("_time"), item.alias("_id"))
        edge, last = nth_smallest(keys, "_time", "_id", n_test - (rows - timed), stats=stats)
        boundary = F.lit(edge).cast(kind)
        is_test = time.isNull() | (time < boundary) | ((time == boundary) & (item <= F.lit(last)))
    else:
        keys = df.where(time.isNull()).select(F.lit("1970-01-01").cast(kind).alias("_time"), item.alias("_id"))
        _, last = nth_smallest(keys, "_time", "_id", n_test)
        is_test = time.isNull() & (item <= F.lit(last))
    return df.where(~is_test), df.where(is_test)


def user_time_split(
    df: DataFrame,
    train_ratio: float = 0.8,
    time_column: str = "impression_time",
    id_column: str = "article_id",
    user_column: str = "user_id",
    hot_rows: int = HOT_GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): per user, the first share of rows by time is the train part.

    A user with one row is all train; otherwise at least one row is test.
    """
    ranked = rank_within(df, user_column, [time_column, id_column], "_position", "_rows", hot_rows)
    cut = F.when(F.col("_rows") < 2, F.col("_rows")).otherwise(
        F.least(truncated_share(F.col("_rows"), train_ratio), F.col("_rows") - 1)
    )
    in_train = F.col("_position") <= cut
    return (
        ranked.where(in_train).drop("_position", "_rows"),
        ranked.where(~in_train).drop("_position", "_rows"),
    )


def sample_users(users: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """Exactly ``size`` distinct users, the same ones on every run; all of them if fewer."""
    distinct = users.select("user_id").distinct()
    if size is None:
        return distinct
    return distinct.orderBy(unit_hash(F.col("user_id") + F.lit(seed)), "user_id").limit(size)
