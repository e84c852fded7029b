"""List columns to rows, and rows to 0/1 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_parallel(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per position of several list columns walked in lockstep.

    An empty or null list gives one row with nulls, and a shorter list is padded with
    nulls.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline_outer(F.arrays_zip(*[F.col(c) for c in columns])))


def explode_labels(df: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """Long form (key, label) of a list column; an empty list gives a null label."""
    return df.select(key, F.explode_outer(column).alias(label))


def label_name(prefix: str, value) -> str:
    return f"{prefix}{'null' if value is None else value}"


def distinct_labels(long: DataFrame, label: str, most: int = 5000) -> list:
    """The distinct labels in order; more than ``most`` of them raises, as columns would not help then."""
    rows = long.select(label).distinct().orderBy(F.col(label).asc_nulls_first()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{label} has more than {most} values: keep the long form")
    return [r[0] for r in rows]


def wide_flags(long: DataFrame, key: str, label: str, values: list, prefix: str) -> DataFrame:
    """One row per key with a 0/1 column for each of ``values``.

    Conditional maxima in one partial aggregation: what a pivot with listed values
    does, and a null label gets its own column.
    """
    flags = [
        F.max(F.when(F.col(label).eqNullSafe(F.lit(v)), F.lit(1)).otherwise(F.lit(0))).alias(label_name(prefix, v))
        for v in values
    ]
    return long.groupBy(key).agg(*flags)


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` per value of a list or scalar column, which is dropped."""
    is_list = dict(df.dtypes)[column].startswith("array")

    def holds(value):
        if is_list:
            return F.coalesce(F.array_contains(column, F.lit(value)), F.lit(False))
        return F.col(column).eqNullSafe(F.lit(value))

    return df.withColumns({label_name(f"{column}_", v): holds(v).cast("int") for v in values}).drop(column)
