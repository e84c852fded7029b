"""Registered queries: sources, cleaning, joins, aggregations, splits, features, exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import (
    cosine,
    dot,
    epoch_micros,
    file_label,
    l2_norm,
    l2_normalise,
    log_read_score,
    min_max,
    rank_discount,
    truncated_share,
    unit_hash,
)
from newsloom.models.popularity import most_read, popularity
from newsloom.models.profile import mean_vectors
from newsloom.operators import clean, explore, interactions, splits
from newsloom.operators.ranking import global_rank
from newsloom.operators.reader_bitmaps import ReaderBitmaps, number_users
from newsloom.plans import experiments
from newsloom.plans.given_tables import GivenTables
from newsloom.plans.oracle import SCORED, hash_of, popular, with_ctes
from newsloom.plans.registry import ORACLES, query, rounded, scratch
from newsloom.sources import merge_run_logs, write_csv, write_parquet


def known(t: GivenTables):
    return clean.reduce_behaviors(t.train, t.validation)


# --- sources and sinks -------------------------------------------------------------


@query("a1_parquet_read", "SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def _(t):
    return t.table("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


@query(
    "a3_parquet_round_trip",
    with_ctes("behaviors known", "SELECT user_id, article_id, round(sum(read_time), 6) AS score FROM known GROUP BY ALL"),
)
def _(t):
    long = interactions.history_interactions(t.history)
    stored = write_parquet(long, scratch(t.spark, "user-item"))
    return stored.select("user_id", "article_id", rounded("score", "score"))


@query(
    "a3_bucketed_user_items",
    with_ctes("behaviors known", """
SELECT user_id, article_id, round(sum(coalesce(read_time, 0)), 6) AS score,
  round(sum(coalesce(read_time, 0)) / nullif(sum(sum(coalesce(read_time, 0))) OVER (PARTITION BY user_id), 0), 6) AS share
FROM known GROUP BY user_id, article_id"""),
)
def _(t):
    reads = t.behaviors.where("article_id IS NOT NULL")
    found = experiments.bucketed_reads(t, reads)
    return found.select("user_id", "article_id", rounded("score", "score"), rounded("share", "share"))


NULL_TOTALS = with_ctes(
    "behaviors known articles inter",
    """
SELECT 'behaviors' AS dataset, CAST(sum((article_id IS NULL)::INT + (scroll_percentage IS NULL)::INT + (age IS NULL)::INT
  + (read_time IS NULL)::INT + (user_id IS NULL)::INT + (impression_time IS NULL)::INT) AS BIGINT) AS nulls FROM behaviors
UNION ALL SELECT 'articles', CAST(sum((category IS NULL)::INT + (published_time IS NULL)::INT) AS BIGINT) FROM articles
UNION ALL SELECT 'vectors', CAST(sum((embedding IS NULL)::INT) AS BIGINT) FROM embeddings
UNION ALL SELECT 'interactions', CAST(sum((max_scroll IS NULL)::INT + (total_readtime IS NULL)::INT) AS BIGINT) FROM inter""",
)


def null_totals(t):
    return explore.null_totals(
        {
            "behaviors": t.behaviors,
            "articles": t.articles,
            "vectors": t.vectors,
            "interactions": interactions.collaborative_interactions(t.train, t.validation),
        }
    )


@query("l5_null_totals", NULL_TOTALS)
def _(t):
    return null_totals(t)


@query("a4_csv_null_summary", NULL_TOTALS)
def _(t):
    path = scratch(t.spark, "null-counts")
    write_csv(null_totals(t), path)
    return t.spark.read.schema("dataset string, nulls long").option("header", True).csv(path)


@query(
    "a5_merge_run_logs",
    """
SELECT 'event_' || event_type AS model, 'fit' AS method, round(sum(value), 2) AS duration, CAST(count(*) AS DOUBLE) AS emissions,
  CAST(NULL AS DOUBLE) AS emissions_rate, CASE WHEN event_type <> 'view' THEN max(value) END AS energy_consumed
FROM events GROUP BY event_type, CAST(ts AS DATE)""",
)
def _(t):
    folder = scratch(t.spark, "run-logs")
    experiments.daily_run_logs(t, folder)
    return merge_run_logs(t.spark, folder)


@query(
    "g11_file_labels",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown_model' ELSE event_type || '_k' || user_id END AS model,
  CASE WHEN event_id % 3 = 0 THEN 'unknown_method' WHEN event_id % 3 = 1 THEN 'fit' ELSE 'recommend' END AS method
FROM events""",
)
def _(t):
    stem = F.concat_ws("_", "event_type", F.concat(F.lit("k"), F.col("user_id").cast("string")))
    third = F.col("event_id") % 3
    name = (
        F.when(third == 0, F.concat("event_type", F.lit(".csv")))
        .when(third == 1, F.concat(stem, F.lit("_fit_emission.csv")))
        .otherwise(F.concat(stem, F.lit("_recommend.csv")))
    )
    model, method = file_label(name)
    return t.table("events").select("event_id", model.alias("model"), method.alias("method"))


# --- cleaning ----------------------------------------------------------------------


@query(
    "b1_clean_table",
    with_ctes("behaviors", "SELECT impression_id, user_id, article_id, scroll_percentage FROM behaviors "
              "WHERE article_id IS NOT NULL AND scroll_percentage IS NOT NULL"),
)
def _(t):
    return clean.clean_table(
        t.behaviors,
        remove_columns=["age", "device_type", "impression_time", "read_time"],
        filter_null_columns=["article_id", "scroll_percentage"],
    )


@query(
    "b1_mean_fill_and_expand",
    with_ctes("behaviors known", """
SELECT impression_id, round(coalesce(scroll_percentage, (SELECT avg(scroll_percentage) FROM known)), 6) AS scroll_percentage,
  (device_type = 'click')::INT AS device_type_click, (device_type = 'view')::INT AS device_type_view
FROM known"""),
)
def _(t):
    cleaned = clean.clean_table(
        t.behaviors.select("impression_id", "article_id", "scroll_percentage", "device_type"),
        filter_null_columns=["article_id"],
        predict_columns=["scroll_percentage"],
        expand_columns={"device_type": ["click", "view"]},
    )
    return cleaned.select(
        "impression_id", rounded("scroll_percentage", "scroll_percentage"), "device_type_click", "device_type_view"
    )


@query(
    "b3_standard_behaviors",
    with_ctes("behaviors known", "SELECT impression_id, user_id, article_id, impression_time, read_time, "
              "scroll_percentage, device_type FROM known"),
)
def _(t):
    return clean.clean_train_and_validation(
        t.train, t.validation, remove_columns=["age"], filter_null_columns=["article_id"]
    )


@query("b4_clean", with_ctes("behaviors known", "SELECT impression_id, article_id, impression_time, user_id FROM known"))
def _(t):
    return known(t)


@query(
    "b10_membership",
    with_ctes("behaviors known", """
SELECT user_id, count(DISTINCT article_id) AS read_listed,
  (SELECT count(*) FROM embeddings) - count(DISTINCT article_id) AS unread
FROM known u WHERE article_id IN (SELECT vec_id FROM embeddings) GROUP BY user_id"""),
)
def _(t):
    pairs = clean.known_pairs(t.behaviors).join(t.articles.select("article_id"), "article_id", "left_semi")
    listed = t.articles.agg(F.count("*")).scalar()
    return pairs.groupBy("user_id").agg(F.count("*").alias("read_listed")).withColumn("unread", listed - F.col("read_listed"))


@query(
    "b15_prefixed_topics",
    "SELECT vec_id AS article_id, " + ", ".join(f"max((t = {v})::INT) AS topic_{v}" for v in range(17)) + " "
    "FROM (SELECT vec_id, label AS t FROM embeddings UNION ALL SELECT vec_id, 10 + vec_id % 7 FROM embeddings) GROUP BY vec_id",
)
def _(t):
    wide = t.topics.groupBy("article_id").pivot("topic", list(range(17))).agg(F.first(F.lit(1))).na.fill(0)
    return clean.prefix_columns(wide, "topic_", ["article_id"])


@query(
    "b16_click_count",
    with_ctes("behaviors known", "SELECT user_id, count(*) AS clicks FROM known GROUP BY user_id"),
)
def _(t):
    return interactions.clicked_pairs(t.behaviors).where("clicked = 1").groupBy("user_id").agg(F.count("*").alias("clicks"))


def standard(t):
    return clean.clean_standard_set(experiments.standard_set(t))


@query(
    "a2_standard_articles",
    with_ctes("articles", """
SELECT CAST(article_id AS INTEGER) AS article_id, 'title ' || article_id AS title, published_time AS last_modified_time, premium, published_time,
  CAST(category AS INTEGER) AS category, round(article_id / 8, 6) AS sentiment_score,
  CASE WHEN article_id % 10 = 0 THEN 0 ELSE 2 END AS n_topics FROM articles"""),
)
def _(t):
    found, _vectors, _behaviors = standard(t)
    return found.select(
        "article_id",
        F.concat(F.lit("title "), F.col("article_id").cast("string")).alias("title"),
        "last_modified_time",
        "premium",
        "published_time",
        "category",
        rounded("sentiment_score", "sentiment_score"),
        (F.size("topics") if "topics" in found.columns else F.lit(-1)).alias("n_topics"),
    )


@query(
    "a2_standard_vectors",
    "SELECT CAST(vec_id AS INTEGER) AS article_id, d, round(x, 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, "
    "generate_subscripts(embedding, 1)::INT AS d FROM embeddings) q",
)
def _(t):
    _articles, vectors, _behaviors = standard(t)
    dims = vectors.select("article_id", F.posexplode("document_vector").alias("d", "x"))
    return dims.select("article_id", (F.col("d") + 1).alias("d"), rounded("x", "x"))


@query(
    "b3_standard_set_behaviors",
    with_ctes("behaviors known", """
SELECT impression_id, CAST(article_id AS INTEGER) AS article_id, impression_time, round(CAST(read_time AS FLOAT)::DOUBLE, 2) AS read_time,
  CASE WHEN impression_id % 5 = 0 THEN 2 ELSE 1 END AS device_type, user_id FROM known"""),
)
def _(t):
    _articles, _vectors, rows = standard(t)
    return rows.select(
        "impression_id", "article_id", "impression_time", F.round(F.col("read_time").cast("double"), 2).alias("read_time"),
        F.col("device_type").cast("int").alias("device_type"), "user_id",
    )


@query(
    "b3_standard_articles_in_order",
    with_ctes("articles", "SELECT published_time, row_number() OVER (ORDER BY published_time DESC NULLS FIRST) AS position FROM articles"),
)
def _(t):
    articles, _vectors, _rows = standard(t)
    # The place of a row in the sorted table; equal times may change places, so the id is left out.
    placed = articles.select("published_time", F.monotonically_increasing_id().alias("at"))
    return global_rank(placed, [F.col("at").asc()], "position").select("published_time", "position")


@query(
    "g12_prefix_columns",
    "SELECT vec_id AS article_id, " + ", ".join(f"max((t = {v})::INT) AS topic_{v}" for v in range(17)) + " "
    "FROM (SELECT vec_id, label AS t FROM embeddings UNION ALL SELECT vec_id, 10 + vec_id % 7 FROM embeddings) GROUP BY vec_id",
)
def _(t):
    # The one-hot columns are found again by their prefix among others.
    wide = interactions.topic_features(t.articles.withColumn("views", F.lit(1)), t.topics, values=list(range(17)))
    return wide.select("article_id", *clean.columns_starting(wide, "topic_"))


# --- joins -------------------------------------------------------------------------


@query(
    "c1_freshness_join",
    with_ctes("behaviors known articles", "SELECT k.impression_id, a.published_time, a.category FROM known k LEFT JOIN articles a USING (article_id)"),
)
def _(t):
    rows = t.behaviors.where("article_id IS NOT NULL").select("impression_id", "article_id")
    return rows.join(t.articles, "article_id", "left").select("impression_id", "published_time", "category")


@query(
    "c2_all_pairs",
    with_ctes("articles", "SELECT u.user_id, a.article_id FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN articles a"),
)
def _(t):
    return interactions.user_article_pairs(t.users, t.articles)


@query(
    "c4_catalogue_counts",
    with_ctes("behaviors known", "SELECT e.vec_id AS article_id, count(k.article_id) AS count FROM embeddings e "
              "LEFT JOIN known k ON k.article_id = e.vec_id GROUP BY e.vec_id"),
)
def _(t):
    counts = popularity(t.behaviors)
    return t.articles.select("article_id").join(counts, "article_id", "left").na.fill(0, ["count"])


@query(
    "c5_articles_with_vectors",
    with_ctes("articles", """
SELECT article_id, CAST(category AS DOUBLE) AS category, CAST(premium AS DOUBLE) AS premium,
  CAST(epoch_us(published_time) AS DOUBLE) AS published_time, d, round(x, 6) AS x
FROM (SELECT a.*, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT AS d
      FROM articles a JOIN embeddings ON vec_id = article_id) q"""),
)
def _(t):
    from newsloom.models.cosine import article_embeddings

    items = article_embeddings(t.articles, t.vectors)
    dims = items.select("article_id", "category", "premium", "published_time", F.posexplode("vec").alias("d", "x"))
    return dims.withColumns({"d": F.col("d") + 1, "x": rounded("x", "x")})


@query(
    "h7_items_table",
    with_ctes("articles", "SELECT article_id, category, premium, round(list_sum(embedding::DOUBLE[]), 6) AS mass FROM articles "
              "LEFT JOIN embeddings ON vec_id = article_id"),
)
def _(t):
    items = interactions.items_with_vectors(t.articles, t.vectors)
    mass = F.aggregate("document_vector", F.lit(0.0), lambda total, x: total + x.cast("double"))
    return items.select("article_id", "category", "premium", rounded(mass, "mass"))


# --- aggregations ------------------------------------------------------------------


def _interactions(source):
    return source.select(
        "article_id", "user_id", rounded(F.log1p("total_readtime"), "log_readtime"), rounded("max_scroll", "max_scroll")
    )


@query(
    "d1_cf_interactions",
    with_ctes("behaviors known inter", "SELECT article_id, user_id, round(ln(1 + total_readtime), 6) AS log_readtime, "
              "round(max_scroll, 6) AS max_scroll FROM inter"),
)
def _(t):
    return _interactions(interactions.collaborative_interactions(t.train, t.validation))


@query(
    "d1_cf_interactions_sum",
    with_ctes("behaviors known", "SELECT article_id, user_id, round(ln(1 + sum(read_time)), 6) AS log_readtime, "
              "round(max(scroll_percentage), 6) AS max_scroll FROM known GROUP BY article_id, user_id"),
)
def _(t):
    return _interactions(interactions.collaborative_interactions(t.train, t.validation, readtime_agg="sum"))


@query(
    "d1_cf_interactions_big",
    with_ctes("big inter_big", "SELECT article_id, user_id, round(ln(1 + total_readtime), 6) AS log_readtime, "
              "round(max_scroll, 6) AS max_scroll FROM inter_big"),
)
def _(t):
    return _interactions(interactions.collaborative_interactions(t.big_train, t.big_validation))


@query(
    "d2_time_roll_up",
    with_ctes("behaviors known rolled", "SELECT user_id, article_id, round(read_time, 6) AS read_time, "
              "scroll AS scroll_percentage, impression_time FROM rolled"),
)
def _(t):
    rows = interactions.roll_up_times(t.behaviors.where("article_id IS NOT NULL"))
    return rows.select("user_id", "article_id", rounded("read_time", "read_time"), "scroll_percentage", "impression_time")


@query("d3_popularity", with_ctes("big", "SELECT article_id, count(*) AS count FROM big GROUP BY article_id"))
def _(t):
    return popularity(t.big_behaviors)


@query(
    "d6_duplicates",
    with_ctes("behaviors known", "SELECT article_id, user_id, count(*) AS count FROM known GROUP BY ALL HAVING count(*) > 1"),
)
def _(t):
    return explore.duplicate_pairs(known(t))


@query(
    "d8_pair_means",
    with_ctes(f"{SCORED} cells", "SELECT user_id, article_id, round(rating, 6) AS rating FROM cells"),
)
def _(t):
    scored = interactions.interaction_scores(t.behaviors, t.articles)
    cells = scored.groupBy("user_id", "article_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("rating"))
    return cells.select("user_id", "article_id", rounded("rating", "rating"))


@query(
    "d11_history_wide",
    with_ctes("behaviors known", """
SELECT u.user_id, a.article_id, round(coalesce(s.score, 0), 6) AS score
FROM (SELECT DISTINCT user_id FROM known) u CROSS JOIN (SELECT DISTINCT article_id FROM known) a
LEFT JOIN (SELECT user_id, article_id, sum(read_time) AS score FROM known GROUP BY ALL) s
  ON s.user_id = u.user_id AND s.article_id = a.article_id"""),
)
def _(t):
    long = interactions.history_interactions(t.history)
    wide = long.groupBy("user_id").pivot("article_id").agg(F.sum("score")).na.fill(0.0)
    # Back to rows, to compare every column of the wide form.
    articles = [c for c in wide.columns if c != "user_id"]
    cells = F.inline(F.array(*[F.struct(F.lit(int(c)).alias("article_id"), F.col(c).alias("score")) for c in articles]))
    return wide.select("user_id", cells).select(
        "user_id", F.col("article_id").cast("long").alias("article_id"), rounded("score", "score")
    )


@query(
    "d12_min_max",
    with_ctes("behaviors", "SELECT impression_id, round((read_time - lo) / (hi - lo), 6) AS scaled FROM behaviors "
              "CROSS JOIN (SELECT min(read_time) AS lo, max(read_time) AS hi FROM behaviors) m"),
)
def _(t):
    low, high = t.behaviors.agg(F.min("read_time")).scalar(), t.behaviors.agg(F.max("read_time")).scalar()
    return t.behaviors.select("impression_id", rounded(min_max(F.col("read_time"), low, high), "scaled"))


@query(
    "d14_distinct_pairs",
    with_ctes("behaviors known", "SELECT DISTINCT user_id, article_id FROM known"),
)
def _(t):
    return known(t).dropDuplicates(["user_id", "article_id"]).select("user_id", "article_id")


@query(
    "d15_distinct_counts",
    with_ctes("big", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT article_id) AS articles, count(*) AS n FROM big"),
)
def _(t):
    return t.big_behaviors.agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("article_id").alias("articles"), F.count("*").alias("n")
    )


DESCRIBED = ["impression_id", "user_id", "article_id", "read_time", "scroll_percentage", "age"]


@query(
    "d18_describe",
    with_ctes("behaviors", """
""" + "\nUNION ALL ".join(
        f"SELECT '{name}' AS summary, " + ", ".join(f"round(CAST({sql}({c}) AS DOUBLE), 6) AS {c}" for c in DESCRIBED) + " FROM behaviors"
        for name, sql in (("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max"))
    )),
)
def _(t):
    described = t.behaviors.select(DESCRIBED).summary("count", "mean", "stddev", "min", "max")
    return described.select("summary", *[rounded(c, c) for c in DESCRIBED])


@query(
    "d19_items_per_user",
    with_ctes("behaviors known", "SELECT user_id, count(DISTINCT article_id) AS items, CAST(sum(DISTINCT article_id) AS BIGINT) AS id_sum FROM known GROUP BY user_id"),
)
def _(t):
    return clean.known_pairs(t.behaviors).groupBy("user_id").agg(F.count("*").alias("items"), F.sum("article_id").alias("id_sum"))


# --- splits and samples ------------------------------------------------------------


@query(
    "e1_random_split_counts",
    with_ctes("behaviors known hash_train hash_test", """
SELECT 'train' AS part, count(*) AS n, CAST(sum(impression_id) AS BIGINT) AS id_sum FROM hash_train
UNION ALL SELECT 'test', count(*), CAST(sum(impression_id) AS BIGINT) FROM hash_test"""),
)
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    part = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("impression_id").alias("id_sum"))
    return part(train, "train").unionByName(part(test, "test"))


@query(
    "e2_time_split",
    with_ctes("behaviors known by_time time_test", "SELECT impression_id, user_id, article_id, impression_time FROM time_test"),
)
def _(t):
    _, test = splits.time_split(known(t), test_ratio=0.3)
    return test.select("impression_id", "user_id", "article_id", "impression_time")


@query(
    "e3_time_split_columns",
    "SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS nth, "
    "count(*) OVER () AS n FROM orders) q WHERE nth > CAST(floor(n * 0.2::DOUBLE) AS BIGINT)",
)
def _(t):
    orders = t.table("orders").select("o_orderkey", "o_orderdate")
    train, _test = splits.time_split(orders, "o_orderdate", "o_orderkey", 0.2)
    return train


@query(
    "e4_user_time_split",
    with_ctes("behaviors known", """
SELECT impression_id, user_id, nth <= CASE WHEN n < 2 THEN n ELSE least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1) END AS in_train
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impression_time, article_id) AS nth,
        count(*) OVER (PARTITION BY user_id) AS n FROM known) q"""),
)
def _(t):
    train, test = splits.user_time_split(known(t), 0.8)
    rows = lambda df, flag: df.select("impression_id", "user_id", F.lit(flag).alias("in_train"))
    return rows(train, True).unionByName(rows(test, False))


MISSING = "CASE WHEN impression_id % {} = 0 THEN NULL ELSE {} END"


def with_missing(t, column: str, every: int):
    """Raw behaviors in which each ``every``-th impression lacks ``column``."""
    lacking = F.when(F.col("impression_id") % every != 0, F.col(column))
    return t.behaviors.withColumns({"row": F.col("impression_id"), column: lacking})


def both_parts(train, test, *columns: str):
    part = lambda df, name: df.select(*columns, F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


@query(
    "e1_random_split_nulls",
    with_ctes("behaviors", f"""
SELECT impression_id AS "row", user_id, CASE WHEN impression_id % 7 <> 0 AND {hash_of('impression_id')} < 0.3::DOUBLE
  THEN 'test' ELSE 'train' END AS part FROM behaviors"""),
)
def _(t):
    return both_parts(*splits.random_split(with_missing(t, "impression_id", 7), 0.3), "row", "user_id")


@query(
    "e2_time_split_nulls",
    with_ctes("behaviors", f"""
SELECT impression_id AS "row", user_id, CASE WHEN nth <= CAST(floor(n * 0.3::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (ORDER BY {MISSING.format(11, 'impression_time')} NULLS FIRST, impression_id) AS nth,
        count(*) OVER () AS n FROM behaviors) q"""),
)
def _(t):
    return both_parts(*splits.time_split(with_missing(t, "impression_time", 11), test_ratio=0.3), "row", "user_id")


@query(
    "e4_user_time_split_hot",
    with_ctes("behaviors", f"""
SELECT impression_id, coalesce(who, -1) AS user_id,
  nth <= CASE WHEN n < 2 THEN n ELSE least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1) END AS in_train
FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY impression_time, impression_id) AS nth, count(*) OVER (PARTITION BY who) AS n
      FROM (SELECT *, {MISSING.format(5, 'user_id')} AS who FROM behaviors) b) q"""),
)
def _(t):
    # Nearly every group is hot, the one without a user among them.
    train, test = splits.user_time_split(with_missing(t, "user_id", 5), 0.8, id_column="impression_id", hot_rows=2)
    user = F.coalesce("user_id", F.lit(-1)).alias("user_id")
    rows = lambda df, flag: df.select("impression_id", user, F.lit(flag).alias("in_train"))
    return rows(train, True).unionByName(rows(test, False))


@query("e5_current_article", with_ctes("behaviors known current", "SELECT user_id, current FROM current"))
def _(t):
    from newsloom.models import RingBuffer

    return RingBuffer(known(t)).current_articles()


@query(
    "e9_user_sample",
    f"SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u ORDER BY {hash_of('(user_id + 42)')}, user_id LIMIT 50",
)
def _(t):
    return splits.sample_users(t.users, 50)


# --- sort, limit, reshape ----------------------------------------------------------


@query("f3_global_top_k", with_ctes("big", f"SELECT article_id, c AS count, rank AS position FROM ({popular('big', 100)}) p"))
def _(t):
    return most_read(popularity(t.big_behaviors), 100)


@query(
    "f8_schema",
    """
SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS dtype
FROM (DESCRIBE SELECT * FROM events)""",
)
def _(t):
    return explore.schema_table(t.table("events"))


@query(
    "f9_item_union",
    with_ctes("behaviors known", "SELECT DISTINCT article_id FROM known"),
)
def _(t):
    return known(t).select("article_id").distinct()


# --- scalar and vector functions ---------------------------------------------------


@query(
    "g1_scalar_functions",
    with_ctes("behaviors", f"""
SELECT impression_id, round(ln(read_time + 1) * scroll_percentage, 6) AS engagement, epoch_us(impression_time) AS micros,
  CAST(floor(impression_id * 0.3::DOUBLE) AS BIGINT) AS share, round(1 / log2(impression_id % 10 + 2), 6) AS discount,
  round({hash_of('impression_id')}, 6) AS hash
FROM behaviors"""),
)
def _(t):
    return t.behaviors.select(
        "impression_id",
        rounded(log_read_score(F.col("read_time"), F.col("scroll_percentage")), "engagement"),
        epoch_micros(F.col("impression_time")).alias("micros"),
        truncated_share(F.col("impression_id"), 0.3).alias("share"),
        rounded(rank_discount(F.col("impression_id") % 10 + 1), "discount"),
        rounded(unit_hash(F.col("impression_id")), "hash"),
    )


@query(
    "g7_vector_functions",
    """
SELECT a.vec_id AS article_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
  round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
  round(a.embedding[1]::DOUBLE / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS first
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    a = t.vectors
    b = t.vectors.select((F.col("article_id") - 1).alias("article_id"), F.col("document_vector").alias("other"))
    v, w = F.col("document_vector"), F.col("other")
    return a.join(b, "article_id").select(
        "article_id",
        rounded(dot(v, w), "dot"),
        rounded(l2_norm(v), "norm"),
        rounded(cosine(v, w), "cosine"),
        rounded(F.get(l2_normalise(v), F.lit(0)), "first"),
    )


@query(
    "g9_mean_vectors",
    "SELECT CAST(label AS BIGINT) AS category, d, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, "
    "generate_subscripts(embedding, 1)::INT AS d FROM embeddings) q GROUP BY label, d",
)
def _(t):
    rows = t.table("embeddings").select(F.col("label").cast("long").alias("category"), "embedding")
    means = mean_vectors(rows, "category", "embedding")
    return means.select("category", F.posexplode("vec").alias("d", "x")).select(
        "category", (F.col("d") + 1).alias("d"), rounded("x", "mean")
    )


# --- features ----------------------------------------------------------------------


@query(
    "h1_interaction_scores",
    with_ctes(SCORED, "SELECT user_id, article_id, impression_time, round(score, 6) AS score FROM scored"),
)
def _(t):
    scored = interactions.interaction_scores(t.behaviors, t.articles)
    return scored.select("user_id", "article_id", "impression_time", rounded("score", "score"))


@query(
    "h2_binary_matrix",
    with_ctes("behaviors known articles", """
SELECT u.user_id, a.article_id, coalesce(k.clicked, 0) AS clicked
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN articles a
LEFT JOIN (SELECT user_id, article_id, 1 AS clicked FROM known) k ON k.user_id = u.user_id AND k.article_id = a.article_id"""),
)
def _(t):
    return interactions.binary_matrix(t.behaviors, t.users, t.articles)


@query(
    "h2_negatives",
    with_ctes("behaviors known articles", f"""
SELECT user_id, article_id, 1 AS clicked FROM known WHERE article_id IN (SELECT article_id FROM articles)
UNION ALL
SELECT user_id, article_id, 0 FROM (
  SELECT u.user_id, a.article_id, row_number() OVER (PARTITION BY u.user_id
    ORDER BY (a.place - CAST(floor({hash_of('u.user_id')} * a.n) AS BIGINT) + a.n) % a.n) AS nth
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS place, count(*) OVER () AS n FROM articles) a
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id = u.user_id AND k.article_id = a.article_id)) q
WHERE nth <= 5"""),
)
def _(t):
    return interactions.binary_matrix(t.behaviors, t.users, t.articles, negatives_per_user=5)


@query(
    "h2_click_counts",
    with_ctes("behaviors known articles", """
SELECT a.article_id, count(k.user_id) AS positives,
  (SELECT count(DISTINCT user_id) FROM events) - count(DISTINCT k.user_id) AS negatives
FROM articles a LEFT JOIN known k USING (article_id) GROUP BY a.article_id"""),
)
def _(t):
    return interactions.click_counts(t.behaviors, t.users, t.articles)


@query("h2_bitmap_click_counts", ORACLES["h2_click_counts"])
def _(t):
    # Two loads, merged bit by bit: a user who read an article in both is one reader.
    places = number_users(t.users)
    loads = [ReaderBitmaps.of(part, places) for part in (t.train, t.validation)]
    return loads[0].merged(loads[1]).click_counts(t.articles)


@query(
    "c12_common_readers",
    with_ctes("behaviors known articles", """
SELECT a.article_id AS "first", b.article_id AS "second",
  (SELECT count(*) FROM (SELECT DISTINCT user_id FROM known k WHERE k.article_id = a.article_id
     INTERSECT SELECT DISTINCT user_id FROM known l WHERE l.article_id = b.article_id) s) AS readers
FROM articles a JOIN articles b ON b.article_id = a.article_id + 1 OR b.article_id = a.article_id"""),
)
def _(t):
    # Each article with itself and with the next one.
    first = t.articles.select(F.col("article_id").alias("first"))
    second = t.articles.select(F.col("article_id").alias("second"))
    pairs = first.select("first", F.explode(F.array(F.col("first"), F.col("first") + 1)).alias("second")).join(second, "second")
    return ReaderBitmaps.of(t.behaviors, number_users(t.users)).common_readers(pairs)


@query(
    "h4_weighted_scores",
    with_ctes("behaviors known inter", "SELECT user_id, article_id, round(ln(1 + max_scroll * 0.1::DOUBLE + total_readtime), 6) AS log_score FROM inter"),
)
def _(t):
    rows = interactions.weighted_interactions(interactions.collaborative_interactions(t.train, t.validation), 0.1, 1.0)
    return rows.select("user_id", "article_id", rounded(F.log1p("interaction_score"), "log_score"))


@query(
    "h5_history_interactions",
    with_ctes("behaviors known", "SELECT user_id, article_id, round(sum(read_time), 6) AS score FROM known GROUP BY user_id, article_id"),
)
def _(t):
    return interactions.history_interactions(t.history).select("user_id", "article_id", rounded("score", "score"))


TOPIC_VALUES = [None, *range(17)]


@query(
    "h6_topic_onehot",
    "SELECT vec_id AS article_id, (vec_id % 2 = 0)::INT AS premium, (vec_id % 10 = 0)::INT AS topic_null, "
    + ", ".join(
        f"(vec_id % 10 <> 0 AND (label = {v} OR 10 + vec_id % 7 = {v}))::INT AS topic_{v}" for v in range(17)
    )
    + " FROM embeddings",
)
def _(t):
    return interactions.topic_features(t.topic_lists, values=TOPIC_VALUES)


@query(
    "h6_topic_full_articles",
    with_ctes("articles", "SELECT CAST(article_id AS INTEGER) AS article_id, premium::INT AS premium, CAST(category AS INTEGER) AS category, "
    "round(article_id / 8, 6) AS sentiment_score, (article_id % 10 = 0)::INT AS topic_null, "
    + ", ".join(
        f"(article_id % 10 <> 0 AND (category = {v} OR 10 + article_id % 7 = {v}))::INT AS topic_{v}" for v in range(17)
    )
    + " FROM articles"),
)
def _(t):
    # All columns of the full article schema that aren't features are left out.
    values = [None, *[str(v) for v in range(17)]]
    found = interactions.topic_features(experiments.standard_set(t).articles, values=values)
    return found.withColumn("sentiment_score", F.round(F.col("sentiment_score").cast("double"), 6))


# --- exploration -------------------------------------------------------------------


@query(
    "l1_null_counts",
    with_ctes("behaviors", """
SELECT * FROM (
  SELECT 'article_id' AS "column", count(*) - count(article_id) AS nulls FROM behaviors
  UNION ALL SELECT 'scroll_percentage', count(*) - count(scroll_percentage) FROM behaviors
  UNION ALL SELECT 'read_time', count(*) - count(read_time) FROM behaviors
  UNION ALL SELECT 'age', count(*) - count(age) FROM behaviors) q WHERE nulls > 0"""),
)
def _(t):
    return explore.explore(t.behaviors)["null_counts"]


@query(
    "l2_sparsity",
    with_ctes("behaviors known", """
SELECT n AS interactions, users, items, round(1 - n / CAST(users * items AS DOUBLE), 6) AS sparsity
FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT article_id) AS items
      FROM (SELECT DISTINCT user_id, article_id FROM known) p) q"""),
)
def _(t):
    return explore.data_sparsity(known(t)).select("interactions", "users", "items", rounded("sparsity", "sparsity"))


@query(
    "l2_sparsity_big",
    with_ctes("big", """
SELECT n AS interactions, users, items, round(1 - n / CAST(users * items AS DOUBLE), 6) AS sparsity
FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT article_id) AS items
      FROM (SELECT DISTINCT user_id, article_id FROM big) p) q"""),
)
def _(t):
    return explore.data_sparsity(t.big_behaviors).select("interactions", "users", "items", rounded("sparsity", "sparsity"))


@query("l2_sparsity_bitmaps_big", ORACLES["l2_sparsity_big"])
def _(t):
    found = ReaderBitmaps.of(t.big_behaviors, number_users(t.big_behaviors)).sparsity()
    return found.select("interactions", "users", "items", rounded("sparsity", "sparsity"))


@query(
    "l3_clicks",
    with_ctes("behaviors known articles", "SELECT article_id, count(user_id) AS clicks FROM known JOIN articles USING (article_id) GROUP BY article_id"),
)
def _(t):
    return explore.article_clicks(t.behaviors, t.articles)


@query(
    "l4_click_histogram",
    with_ctes("behaviors known articles", """
SELECT r.bin, round(lo + r.bin * w, 6) AS low, round(lo + (r.bin + 1) * w, 6) AS high, count(c.clicks) AS articles
FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(20) g(i)) r
CROSS JOIN (SELECT min(clicks)::DOUBLE AS lo, (max(clicks) - min(clicks))::DOUBLE / 20 AS w
            FROM (SELECT count(user_id) AS clicks FROM known JOIN articles USING (article_id) GROUP BY article_id) x) m
LEFT JOIN (SELECT count(user_id) AS clicks FROM known JOIN articles USING (article_id) GROUP BY article_id) c
  ON least(CAST(floor((c.clicks - lo) / w) AS INTEGER), 19) = r.bin
GROUP BY r.bin, lo, w"""),
)
def _(t):
    bins = explore.click_histogram(explore.article_clicks(t.behaviors, t.articles))
    return bins.select("bin", rounded("low", "low"), rounded("high", "high"), "articles")
