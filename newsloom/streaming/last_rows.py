"""The newest N behaviors of a stream, as keyed state of bounded size.

One buffer for the whole stream would be one key, and so one task. The stream is cut
into shards by a hash of the impression instead; each shard keeps its own newest N
rows, and the newest N of all are among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.streaming.manifest import Manifest

SHARDS = 16
BUFFER = "shard int, version long, impression_time timestamp, impression_id long, user_id long, article_id long"
STATE = "version long, times array<timestamp>, impressions array<long>, users array<long>, articles array<long>"
KEPT = ["impression_time", "impression_id", "user_id", "article_id"]


def _keep_newest(size: int):
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, held = 0, pd.DataFrame({c: [] for c in KEPT})
        if state.exists:
            version, *columns = state.get
            held = pd.DataFrame(dict(zip(KEPT, [list(c) for c in columns])))
        for batch in batches:
            # Trimmed batch by batch: memory is bounded by one Arrow batch and the buffer.
            both = pd.concat([held, batch[KEPT]], ignore_index=True) if len(held) else batch[KEPT]
            newest = both.sort_values(["impression_time", "impression_id"], ascending=False)
            held = newest.head(size).reset_index(drop=True)
        version += 1
        articles = [None if pd.isna(a) else int(a) for a in held["article_id"]]
        times = [pd.Timestamp(t).to_pydatetime() for t in held["impression_time"]]
        state.update(
            (version, times, held["impression_id"].astype("int64").tolist(), held["user_id"].astype("int64").tolist(), articles)
        )
        out = held.copy()
        out["article_id"] = pd.array(articles, dtype="Int64")
        out.insert(0, "shard", key[0])
        out.insert(1, "version", version)
        yield out

    return update


def shard_buffers(behaviors: DataFrame, size: int = 10, shards: int = SHARDS, watermark: str | None = None) -> DataFrame:
    """Streaming (shard, version, ...) rows: each update of a shard repeats its whole buffer.

    ``behaviors`` is a stream with impression_time, impression_id, user_id, article_id.
    ``watermark`` drops rows later than that behind the newest one; without it a late
    row still finds its place by time.
    """
    rows = behaviors.select(
        F.col("impression_time").cast("timestamp").alias("impression_time"),
        F.col("impression_id").cast("long").alias("impression_id"),
        F.col("user_id").cast("long").alias("user_id"),
        F.col("article_id").cast("long").alias("article_id"),
    )
    if watermark:
        rows = rows.withWatermark("impression_time", watermark)
    shard = F.pmod(F.xxhash64("impression_id"), F.lit(shards)).cast("int")
    return (
        rows.withColumn("shard", shard)
        .groupBy("shard")
        .applyInPandasWithState(_keep_newest(size), BUFFER, STATE, "update", "NoTimeout")
    )


def last_rows(updates: DataFrame, size: int = 10) -> DataFrame:
    """The newest ``size`` rows, with their slot, from the shards' written updates."""
    newest = updates.withColumn("_last", F.max("version").over(W.partitionBy("shard")))
    order = [F.col("impression_time").desc(), F.col("impression_id").desc()]
    rows = newest.where(F.col("version") == F.col("_last")).select(KEPT).orderBy(*order).limit(size)
    return rows.withColumn("slot", F.row_number().over(W.orderBy(*order)))


def run_to_table(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available now to ``path`` and stop.

    The file sink appends only, so each micro-batch's updates go through foreachBatch. A
    shard has its own folder, which its next update replaces: the table stays at
    shards x size rows however long the stream runs, and a retried batch writes the same.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("shard").parquet(path)

    query = (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()


def run_to_versions(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available now to ``path``, a whole version for each micro-batch, and stop.

    A version holds the newest buffer of every shard, shards x size rows: those of the batch, and the last
    version's for shards that it doesn't update. It counts when its manifest is there, so a reader
    (``current_buffers``) never meets half of a batch. A batch that was committed is not written
    again, one that wasn't writes the same folder anew.
    """
    store = Manifest(updates.sparkSession, path)

    def commit(batch: DataFrame, batch_id: int) -> None:
        last = store.latest()
        if last and batch_id <= last["version"]:
            return
        # The update is read twice; the state must not be asked twice.
        batch = batch.persist()
        folders = last["folders"] if last else []
        kept = store.read(folders, BUFFER).join(batch.select("shard").distinct(), "shard", "left_anti")
        folder = f"buffers/{batch_id}"
        kept.select(batch.columns).unionByName(batch).write.mode("overwrite").parquet(f"{store.path}/{folder}")
        store.commit(batch_id, [folder], folders)
        batch.unpersist()

    query = (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(commit)
        .start()
    )
    query.awaitTermination()


def current_buffers(spark: SparkSession, path: str) -> DataFrame:
    """The shards' buffers of the newest committed version."""
    store = Manifest(spark, path)
    last = store.latest()
    return store.read(last["folders"] if last else [], BUFFER)
