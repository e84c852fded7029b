"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are ranked after rounding to this many digits, so that the order of a
# distributed sum cannot decide a tie; ties then go to the smaller id.
RANK_DIGITS = 9

# Fixed values of the split hash: Knuth's multiplier and the two moduli.
HASH_MULTIPLIER = 2654435761
HASH_KEY_RANGE = 2**31
HASH_RANGE = 2**32


def rank_key(score: Column) -> Column:
    """What scores are ranked by: whole steps of 10 ** -RANK_DIGITS, in plain double arithmetic."""
    return F.rint(score.cast("double") * F.lit(10.0**RANK_DIGITS))


def best_first(score: str, *ids: str) -> list[Column]:
    """Sort order 'highest score first, missing scores last, then smallest id'."""
    return [rank_key(F.col(score)).desc_nulls_last(), *[F.col(i).asc() for i in ids]]


def unit_hash(key: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) of a whole key; null for a null key."""
    scrambled = F.pmod(key.cast("long"), F.lit(HASH_KEY_RANGE)) * F.lit(HASH_MULTIPLIER)
    return (scrambled % F.lit(HASH_RANGE)).cast("double") / F.lit(float(HASH_RANGE))


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(time.cast("timestamp"))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); null when the range is empty."""
    return F.try_divide((value - low).cast("double"), (high - low).cast("double"))


def log_read_score(read_time: Column, scroll: Column) -> Column:
    """log(1 + read time) weighted by the scroll depth."""
    return F.log1p(read_time) * scroll


def weighted_score(scroll: Column, read_time: Column, scroll_weight: float, read_weight: float) -> Column:
    """Weighted sum of scroll depth and read time; null if either is missing."""
    return scroll * F.lit(float(scroll_weight)) + read_time * F.lit(float(read_weight))


def truncated_share(rows: Column, ratio: float) -> Column:
    """Whole rows in a share of ``rows``, cut towards zero."""
    return F.floor(rows.cast("double") * F.lit(float(ratio)))


def rank_discount(rank: Column) -> Column:
    """Gain of a hit at a 1-based rank."""
    return F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))


def file_label(name: Column) -> tuple[Column, Column]:
    """(model, method) from a file name such as ``user_based_fit_emission.csv``."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"_emission$", "")
    parts = F.split(stem, "_")
    single = F.size(parts) < 2
    model = F.when(single, F.lit("unknown_model")).otherwise(F.regexp_extract(stem, r"^(.*)_[^_]*$", 1))
    method = F.when(single, F.lit("unknown_method")).otherwise(F.element_at(parts, -1))
    return model, method
