"""Whole evaluations: split, fit, recommend, measure."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import metrics, splits
from newsloom.plans.given_tables import GivenTables
from newsloom.plans.registry import scratch
from newsloom.session import pin
from newsloom.sources.csv_tables import write_csv
from newsloom.sources.dataset import ARTICLES_FILE, TRAIN_FILE, VALIDATION_FILE, VECTORS_FILE, Dataset
from newsloom.sources.metric_log import RANKING_METRICS
from newsloom.sources.parquet import write_bucketed
from newsloom.sources.schemas import ARTICLES, BEHAVIORS, DOCUMENT_VECTOR
from newsloom.streaming.click_counts import ClickCounts
from newsloom.streaming.last_rows import current_buffers, last_rows, run_to_versions, shard_buffers
from newsloom.streaming.popularity_state import PopularityState


def standard_set(t: GivenTables) -> Dataset:
    """The given tables written as the standard set, with all its columns, and loaded again."""
    folder = scratch(t.spark, "standard-set")

    def full(df: DataFrame, schema, **more) -> DataFrame:
        """``df`` with the columns of ``schema``: its own, those of ``more``, null otherwise."""
        have = {c: F.col(c) for c in df.columns} | more
        return df.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    number = F.col("article_id").cast("string")
    articles = full(
        t.articles.join(t.topic_lists.select("article_id", "topics"), "article_id"),
        ARTICLES,
        title=F.concat(F.lit("title "), number),
        body=F.concat(F.lit("body "), number),
        last_modified_time=F.col("published_time"),
        total_inviews=F.col("article_id") * 2,
        sentiment_score=F.col("article_id") / 8,
    )
    parts = {
        ARTICLES_FILE: articles,
        VECTORS_FILE: full(t.vectors, DOCUMENT_VECTOR),
        TRAIN_FILE: full(t.train, BEHAVIORS, device_type=F.lit(1), session_id=F.col("impression_id") * 3),
        VALIDATION_FILE: full(t.validation, BEHAVIORS, device_type=F.lit(2), session_id=F.col("impression_id") * 3),
    }
    for name, df in parts.items():
        df.write.parquet(f"{folder}/{name}")
    return Dataset.load(t.spark, folder)


def as_metric_rows(evaluation: DataFrame, model: str) -> DataFrame:
    """(model, metric, value) rows of an ``evaluate`` result."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
          for name, c in zip(RANKING_METRICS, ("precision", "recall", "fpr"))]
    )
    return evaluation.select(F.lit(model).alias("model"), F.inline(entries))


def recommend_for(model, users: DataFrame | None, k: int, sample: int | None = None, seed: int = 42) -> DataFrame:
    """The model's lists for ``users``, or for a fixed sample of them."""
    if users is not None and sample is not None:
        users = splits.sample_users(users, sample, seed)
    return model.recommend(users, n=k)


def evaluate_model(model, test: DataFrame, k: int = 5, users: DataFrame | None = None) -> DataFrame:
    """Average precision, recall and false-positive rate of a fitted model's lists.

    Without ``users`` the test users that the model can score are asked: for others it has
    no list to judge.
    """
    if users is None:
        users = test.select("user_id").distinct()
        users = model.scorable(users) if hasattr(model, "scorable") else users
    return metrics.evaluate(recommend_for(model, users, k), test, k, users)


def model_diversity(
    model, catalogue: DataFrame, users: DataFrame, k: int = 5, user_sample: int | None = None, seed: int = 42
) -> DataFrame:
    """Share of the catalogue that a fitted model recommends to the users, or to a sample."""
    return metrics.aggregate_diversity(recommend_for(model, users, k, user_sample, seed), catalogue, k)


def model_gini(
    model, catalogue: DataFrame, users: DataFrame, k: int = 5, user_sample: int | None = None, seed: int = 42
) -> DataFrame:
    """Concentration of a fitted model's recommendations over the catalogue."""
    return metrics.gini(recommend_for(model, users, k, user_sample, seed), catalogue, k)


def compare_splits(
    behaviors: DataFrame, fit: Callable[[DataFrame], object], k: int = 5, test_ratio: float = 0.30
) -> DataFrame:
    """(split, precision, recall, fpr, users) of one model on the random and the time split."""
    found = []
    for name, split in (("random", splits.random_split), ("time", splits.time_split)):
        train, test = split(behaviors, test_ratio=test_ratio)
        found.append(evaluate_model(fit(train), test, k).withColumn("split", F.lit(name)))
    return found[0].unionByName(found[1])


def variant_grid(
    train: DataFrame,
    test: DataFrame,
    model: type,
    k: int = 5,
    user_sample: int | None = None,
    **fit_options: float,
) -> DataFrame:
    """Ranking metrics of binary and weighted variants, with and without read articles.

    Each variant is fitted once and asked twice; users are train users with test rows.
    """
    train = pin(train)
    users = train.select("user_id").distinct()
    found = []
    for binary in (True, False):
        fitted = model(train, binary_model=binary).fit(**({} if binary else fit_options))
        for allowed in (False, True):
            recommended = fitted.recommend(n=k, allow_read_articles=allowed)
            row = metrics.evaluate_ranking(recommended, test, k, users=users, user_sample=user_sample)
            found.append(
                row.withColumn("model", F.lit("binary" if binary else "weighted")).withColumn("read_allowed", F.lit(allowed))
            )
    out = found[0]
    for row in found[1:]:
        out = out.unionByName(row)
    return out


# Files, and so micro-batches, that the events are streamed in.
STREAM_FILES = 3


def event_stream(t: GivenTables) -> DataFrame:
    """The events as a file stream, read as behaviors without home-page rows.

    The table is written in several files first, so that there are several micro-batches.
    """
    events = t.table("events")
    folder = scratch(t.spark, "stream-events")
    events.repartitionByRange(STREAM_FILES, "event_id").write.parquet(folder)
    rows = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return t.as_behaviors(rows).where("article_id IS NOT NULL")


def stream_last_rows(t: GivenTables, size: int) -> DataFrame:
    """Run the buffer stream over what is there, then read the newest rows."""
    folder = scratch(t.spark, "stream-buffer")
    run_to_versions(shard_buffers(event_stream(t), size), f"{folder}/versions", f"{folder}/checkpoint")
    return last_rows(current_buffers(t.spark, f"{folder}/versions"), size)


def stream_click_counts(t: GivenTables) -> DataFrame:
    """Run the click-count stream over what is there, then read the statistics."""
    folder = scratch(t.spark, "stream-clicks")
    counts = ClickCounts(t.spark, f"{folder}/pairs")
    counts.follow(event_stream(t), f"{folder}/checkpoint").awaitTermination()
    return counts.counts(t.users, t.articles)


def loaded_counts(t: GivenTables, rows: DataFrame, key: str) -> DataFrame:
    """(article_id, count) kept up over three loads of ``rows``: a first part, the rest with wrong articles, a correction."""
    state = PopularityState(t.spark, scratch(t.spark, "popularity"), fanout=2)
    late, spoilt = F.col(key) % 5 == 0, F.col(key) % 10 == 0
    wrong = rows.where(spoilt).withColumn("article_id", F.col("article_id") + 1)
    state.add(rows.where(~late), 0)
    state.add(rows.where(late & ~spoilt).unionByName(wrong), 1)
    state.correct(wrong, rows.where(spoilt), 2)
    return state.counts()


# Buckets of the stored user-item table.
BUCKETS = 16


def bucketed_reads(t: GivenTables, rows: DataFrame) -> DataFrame:
    """(user_id, article_id, score, share): read time per pair and its share of the user's, from a table bucketed by user.

    Both groupings and the join are on the bucket column, so none of them shuffles.
    """
    name = f"newsloom_reads_{uuid.uuid4().hex}"
    reads = rows.select("user_id", "article_id", F.coalesce("read_time", F.lit(0.0)).alias("read_time"))
    stored = write_bucketed(reads, name, scratch(t.spark, "bucketed"), "user_id", BUCKETS)
    pairs = stored.groupBy("user_id", "article_id").agg(F.sum("read_time").alias("score"))
    users = stored.groupBy("user_id").agg(F.sum("read_time").alias("total"))
    return pairs.join(users.hint("merge"), "user_id").select(
        "user_id", "article_id", "score", F.try_divide("score", "total").alias("share")
    )


def daily_run_logs(t: GivenTables, folder: str) -> None:
    """One CSV run log per kind of event, a row per day, named as its model and method.

    Kinds and days are few whatever the number of events, so a file is small.
    """
    day = F.to_date("ts")
    daily = pin(
        t.table("events")
        .groupBy("event_type", day.alias("day"))
        .agg(F.round(F.sum("value"), 2).alias("duration"), F.count("*").alias("emissions"), F.max("value").alias("energy_consumed"))
    )
    jvm = t.spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(t.spark._jsc.hadoopConfiguration())
    for kind in [r[0] for r in daily.select("event_type").distinct().collect()]:
        # Views lack the energy column, as older logs may.
        rows = daily.where(F.col("event_type") == kind).drop("event_type")
        rows = rows.drop("energy_consumed") if kind == "view" else rows
        write_csv(rows, f"{folder}/_{kind}", one_file=True)
        for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/_{kind}/part-*.csv")):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/event_{kind}_fit_emission.csv"))
