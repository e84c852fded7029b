"""Where queries and their DuckDB counterparts are registered."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.given_tables import GivenTables
from newsloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Digits that both engines round results to.
DIGITS = 6


def query(name: str, oracle: str | None = None):
    """Register ``build(tables)`` under ``name``, with the SQL that must give the same rows."""

    def register(build: Callable[[GivenTables], DataFrame]):
        QUERIES[name] = lambda spark, root: build(GivenTables(spark, root))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def rounded(column, name: str):
    """A double result column under ``name``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), DIGITS).alias(name)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder beside the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/newsloom-{what}-{uuid.uuid4().hex}"
