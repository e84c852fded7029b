import pytest
from conftest import at
from pyspark.sql import functions as F

from newsloom.models import MostPopular, RingBuffer
from newsloom.models.popularity import popularity
from newsloom.operators.clean import clean_standard_set, reduce_behaviors
from newsloom.operators.interactions import click_counts
from newsloom.plans.given_tables import GivenTables
from newsloom.sources import Dataset, MetricLog, merge_run_logs, read_parquet, write_csv, write_parquet
from newsloom.plans import experiments
from newsloom.sources.csv_tables import csv_records, text_lines
from newsloom.sources.schemas import ARTICLES, BEHAVIORS, DOCUMENT_VECTOR
from newsloom.streaming import ClickCounts, PopularityState, current_buffers, last_rows, run_to_versions, shard_buffers
from newsloom.streaming.last_rows import run_to_table
from newsloom.streaming.manifest import Manifest, MergedRuns


def test_read_failure_is_a_value_error(spark, tmp_path):
    with pytest.raises(ValueError):
        read_parquet(spark, str(tmp_path / "nothing.parquet"))


def test_parquet_round_trip(spark, tmp_path):
    df = spark.range(100).withColumn("part", F.col("id") % 3)
    back = write_parquet(df, str(tmp_path / "t"), partition_by=["part"])
    assert back.count() == 100
    assert back.where("part = 1").count() == 33


def test_standard_set(spark, tmp_path):
    def empty(schema):
        return spark.createDataFrame([], schema)

    articles = spark.createDataFrame(
        [(1, at(1)), (2, at(9))], "article_id int, published_time timestamp_ntz"
    )
    for name in ARTICLES.fieldNames():
        if name not in articles.columns:
            articles = articles.withColumn(name, F.lit(None).cast(ARTICLES[name].dataType))
    articles.select(ARTICLES.fieldNames()).write.parquet(str(tmp_path / "articles.parquet"))
    empty(DOCUMENT_VECTOR).write.parquet(str(tmp_path / "document_vector.parquet"))
    log = empty(BEHAVIORS).unionByName(
        spark.createDataFrame([(7, 1, 5), (8, None, 5)], "impression_id long, article_id int, user_id long"),
        allowMissingColumns=True,
    )
    for part in ("train", "validation"):
        log.write.parquet(str(tmp_path / part / "behaviors.parquet"))
    data = Dataset.load(spark, str(tmp_path), declared=True)
    cleaned, vectors, behaviors = clean_standard_set(data)
    assert [r["article_id"] for r in cleaned.collect()] == [2, 1]
    assert "image_ids" not in cleaned.columns and vectors.count() == 0
    assert [r["impression_id"] for r in behaviors.collect()] == [7, 7]
    assert "age" not in behaviors.columns and "device_type" in behaviors.columns
    reduced = reduce_behaviors(data.train_behaviors, data.validation_behaviors)
    assert reduced.columns == ["impression_id", "article_id", "impression_time", "user_id"]


def test_merge_run_logs(spark, tmp_path):
    (tmp_path / "m_x_fit_emission.csv").write_text(
        "timestamp,duration,emissions,emissions_rate,energy_consumed\n1,1.5,2,3,4\n2,2.5,2,3,4\n"
    )
    (tmp_path / "solo.csv").write_text("duration,emissions\n9,8\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text("duration\n1\n")
    rows = merge_run_logs(spark, str(tmp_path)).orderBy("duration").collect()
    assert [(r["model"], r["method"], r["duration"], r["emissions_rate"]) for r in rows] == [
        ("m_x", "fit", 1.5, 3.0),
        ("m_x", "fit", 2.5, 3.0),
        ("unknown_model", "unknown_method", 9.0, None),
    ]
    assert list(rows[0].asDict()) == ["model", "method", "duration", "emissions", "emissions_rate", "energy_consumed"]
    write_csv(merge_run_logs(spark, str(tmp_path)), str(tmp_path / "summary"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 3


def test_merge_of_files_in_several_splits(spark, tmp_path):
    # Two header orders, quoted line feeds and commas, doubled quotes, a blank line; files longer than a split.
    rows = [(i, f'run {i}, "quoted"\nnext line\n\n{i}') for i in range(40)]
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    (tmp_path / "a_fit_emission.csv").write_text(
        "duration,note,emissions\n" + "\n".join(f"{i}.5,{quoted(note)},{2 * i}" for i, note in rows) + "\n\n"
    )
    (tmp_path / "b_recommend.csv").write_text('"emissions",duration\n' + "\n".join(f'"{i}",{i}.25' for i in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        lines = text_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > 8
        records = csv_records(lines).where("file = 'a_fit_emission.csv'").orderBy("block", "line").collect()
        assert [r["value"] for r in records[1:]] == [f"{i}.5,{quoted(note)},{2 * i}" for i, note in rows]
        found = merge_run_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["duration"], r["emissions"]) for r in found if r["method"] == "fit") == [(i + 0.5, 2.0 * i) for i, _ in rows]
    other = [r for r in found if r["method"] != "fit"]
    assert sorted((r["duration"], r["emissions"]) for r in other) == [(i + 0.25, float(i)) for i in range(200)]


def test_merge_without_files(spark, tmp_path):
    assert merge_run_logs(spark, str(tmp_path)) is None


def test_metric_log(spark, tmp_path):
    log = MetricLog(spark, str(tmp_path / "metrics"))
    log.append_ranking("a", {"precision@k": 0.5, "recall@k": 0.25})
    log.append_coverage("a", 0.1)
    log.append_gini("b", 0.9)
    rows = {(r["model"], r["metric"]): r["value"] for r in log.read().collect()}
    assert rows == {
        ("a", "precision@k"): 0.5,
        ("a", "recall@k"): 0.25,
        ("a", "fpr@k"): 0.0,
        ("a", "aggregate_diversity"): 0.1,
        ("b", "gini_coefficient"): 0.9,
    }


@pytest.fixture()
def four_files(spark, sf_dir, tmp_path):
    """The events in four files, out of time order."""
    t = GivenTables(spark, sf_dir)
    for i, part in enumerate((2, 0, 3, 1)):
        t.table("events").where(f"event_id % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = (
        spark.readStream.schema(t.table("events").schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "events"))
    )
    return t, t.as_behaviors(stream).where("article_id IS NOT NULL")


def test_stream_buffer_equals_batch(spark, four_files, tmp_path):
    t, stream = four_files
    run_to_table(shard_buffers(stream, 10, shards=3), str(tmp_path / "updates"), str(tmp_path / "checkpoint"))
    updates = spark.read.parquet(str(tmp_path / "updates"))
    assert updates.agg(F.max("version")).first()[0] > 1
    got = [r["impression_id"] for r in last_rows(updates, 10).orderBy("slot").collect()]
    log = reduce_behaviors(t.train, t.validation)
    batch = RingBuffer(log, 10, keep="newest").fit().contents().orderBy("slot").collect()
    assert got == [r["impression_id"] for r in batch]


def test_stream_counts_equal_batch(spark, four_files, tmp_path):
    t, stream = four_files
    counts = ClickCounts(spark, str(tmp_path / "pairs"))
    counts.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
    expected = click_counts(t.behaviors, t.users, t.articles)
    assert counts.counts(t.users, t.articles).exceptAll(expected).isEmpty()
    compacted = counts.compact(str(tmp_path / "compacted"))
    assert expected.exceptAll(compacted.counts(t.users, t.articles)).isEmpty()


def test_buffer_versions_equal_batch(spark, four_files, tmp_path):
    t, stream = four_files
    path = str(tmp_path / "versions")
    run_to_versions(shard_buffers(stream, 10, shards=3), path, str(tmp_path / "checkpoint"))
    got = [r["impression_id"] for r in last_rows(current_buffers(spark, path), 10).orderBy("slot").collect()]
    log = reduce_behaviors(t.train, t.validation)
    batch = RingBuffer(log, 10, keep="newest").fit().contents().orderBy("slot").collect()
    assert got == [r["impression_id"] for r in batch]
    assert current_buffers(spark, str(tmp_path / "nothing")).count() == 0
    assert Manifest(spark, path).latest()["version"] >= 3


def test_a_version_is_seen_whole(spark, tmp_path, monkeypatch):
    """A crash before the commit leaves the last version; the retried batch then counts once."""
    path = str(tmp_path / "clicks")
    log = spark.createDataFrame([(u, a) for u in range(4) for a in range(3)], "user_id long, article_id long")
    counts = ClickCounts(spark, path, fanout=2)
    counts.add_batch(log, 0)
    seen = counts.runs.rows()
    commit = Manifest.commit

    def crash(*_args, **_more):
        raise RuntimeError("lost")

    monkeypatch.setattr(Manifest, "commit", crash)
    with pytest.raises(RuntimeError):
        counts.add_batch(log, 1)
    assert counts.runs.rows().agg(F.sum("rows")).first()[0] == 12
    monkeypatch.setattr(Manifest, "commit", commit)
    counts.add_batch(log, 1)
    counts.add_batch(log, 1)
    assert counts.runs.rows().agg(F.sum("rows")).first()[0] == 24
    # A read planned on the version before still finds its folders.
    assert seen.agg(F.sum("rows")).first()[0] == 12


def test_runs_stay_few_over_many_batches(spark, tmp_path):
    runs = MergedRuns(spark, str(tmp_path / "runs"), {"k": "long"}, ["n"], fanout=3)
    total = {}
    for batch in range(20):
        rows = [(batch % 4, 1), (7, 2), (batch, -1 if batch % 2 else 1)]
        runs.add(spark.createDataFrame(rows, "k long, n int"), batch)
        for k, n in rows:
            total[k] = total.get(k, 0) + n
        assert len(runs.folders()) <= 6
    assert {r["k"]: r["n"] for r in runs.rows().collect()} == {k: n for k, n in total.items() if n}
    kept = list((tmp_path / "runs" / "runs").iterdir())
    assert len(kept) <= 12 and len(list((tmp_path / "runs" / "manifest").iterdir())) <= 4


def test_stream_counts_over_many_batches(spark, sf_dir, tmp_path):
    t = GivenTables(spark, sf_dir)
    for part in range(20):
        t.table("events").where(f"event_id % 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(t.table("events").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    counts = ClickCounts(spark, str(tmp_path / "pairs"))
    counts.follow(t.as_behaviors(stream).where("article_id IS NOT NULL"), str(tmp_path / "checkpoint")).awaitTermination()
    assert counts.runs.manifest.latest()["version"] == 19 and len(counts.runs.folders()) <= 9
    assert counts.counts(t.users, t.articles).exceptAll(click_counts(t.behaviors, t.users, t.articles)).isEmpty()


def test_late_rows_of_the_buffer(spark, tmp_path):
    rows = [[(at(50), 1), (at(40), 2)], [(at(60), 3), (at(1), 4)], [(at(45), 5), (at(61), 6)]]
    for part in rows:
        spark.createDataFrame([(s, i, 1, i) for s, i in part], "impression_time timestamp_ntz, impression_id long, user_id long, article_id long").coalesce(
            1
        ).write.mode("append").parquet(str(tmp_path / "rows"))
    schema = spark.read.parquet(str(tmp_path / "rows")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    run_to_versions(shard_buffers(stream, 4, shards=2), str(tmp_path / "versions"), str(tmp_path / "checkpoint"))
    found = last_rows(current_buffers(spark, str(tmp_path / "versions")), 4).orderBy("slot").collect()
    # A row that comes late finds its place by time, or none.
    assert [r["impression_id"] for r in found] == [6, 3, 1, 5]


def test_popularity_from_loads(spark, sf_dir, tmp_path):
    t = GivenTables(spark, sf_dir)
    log = reduce_behaviors(t.train, t.validation)
    state = PopularityState(spark, str(tmp_path / "state"), fanout=2)
    wrong = log.where("impression_id % 3 = 0").withColumn("article_id", F.lit(10**6).cast("long"))
    state.add(log.where("impression_id % 3 <> 0").unionByName(wrong), 0)
    state.correct(wrong, log.where("impression_id % 3 = 0"), 1)
    state.correct(wrong, log.where("impression_id % 3 = 0"), 1)
    assert state.counts().exceptAll(popularity(log)).isEmpty() and popularity(log).exceptAll(state.counts()).isEmpty()
    assert MostPopular(log, state.counts()).fit().recommend(n=3).exceptAll(MostPopular(log).fit().recommend(n=3)).isEmpty()


def test_bucketed_reads_do_not_shuffle(spark, sf_dir):
    t = GivenTables(spark, sf_dir)
    found = experiments.bucketed_reads(t, t.behaviors.where("article_id IS NOT NULL"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert found.count() == t.behaviors.where("article_id IS NOT NULL").select("user_id", "article_id").distinct().count()
