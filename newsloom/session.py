"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE is left to coalesce small shuffles, to split skewed join partitions and to
    turn a join into a broadcast only when the measured side is below the threshold.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # A pinned relation's files go when nothing refers to it any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, or a new one on a local master only."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made inside drop their shuffle files when they end, not when the JVM next collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Used where one relation feeds several jobs, or where its partitioning is part of
    the answer: a lost executor then re-reads the same rows in the same partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``pin`` for relations as long as the input whose partitioning doesn't matter: Parquet takes a fraction of the bytes."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
