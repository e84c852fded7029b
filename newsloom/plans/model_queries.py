"""Registered queries: recommenders, metrics, experiments, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.models import (
    ClickModel,
    CosineProfiles,
    ItemCF,
    MostPopular,
    PopularityUserCF,
    RingBuffer,
    TopicCF,
    UserCF,
    UserItemBias,
    WeightedProfiles,
)
from newsloom.models.click import PENALTY
from newsloom.operators import interactions, metrics, splits
from newsloom.operators.clean import reduce_behaviors
from newsloom.plans import experiments, oracle
from newsloom.plans.given_tables import GivenTables
from newsloom.plans.oracle import BIAS, PROFILE, SCORED, evaluated, popular, popular_recs, ranking_evaluated, with_ctes
from newsloom.plans.registry import ORACLES, query, rounded, scratch
from newsloom.session import pin
from newsloom.sources import MetricLog

RECS = "SELECT user_id, article_id, round(score, 6) AS score, rank FROM "
LOG_RECS = "SELECT user_id, article_id, round(ln(1 + score), 6) AS log_score, rank FROM "


def known(t: GivenTables) -> DataFrame:
    return reduce_behaviors(t.train, t.validation)


def inter(t: GivenTables) -> DataFrame:
    return interactions.collaborative_interactions(t.train, t.validation)


def inter_big(t: GivenTables) -> DataFrame:
    return interactions.collaborative_interactions(t.big_train, t.big_validation)


def scored(t: GivenTables) -> DataFrame:
    return interactions.interaction_scores(t.behaviors, t.articles)


def recs(df: DataFrame) -> DataFrame:
    return df.select("user_id", "article_id", rounded("score", "score"), "rank")


def log_recs(df: DataFrame) -> DataFrame:
    """Scores that are sums of read-time products, on a log scale."""
    return df.select("user_id", "article_id", rounded(F.log1p("score"), "log_score"), "rank")


def pairs(df: DataFrame) -> DataFrame:
    return df.select("entity", "neighbor", rounded("sim", "sim"), F.col("rank").cast("int").alias("rank"))


NB = "SELECT entity, neighbor, round(sim, 6) AS sim, CAST(rk AS INTEGER) AS rank FROM "


# --- most popular, ring buffer -----------------------------------------------------


@query("j1_most_popular", with_ctes("behaviors known", popular_recs("known")))
def most_popular(t):
    return MostPopular(known(t)).fit().recommend(n=5)


@query("j1_most_popular_from_loads", with_ctes("behaviors known", popular_recs("known")))
def _(t):
    # The counts come from loads and a correction, not from the log.
    counts = experiments.loaded_counts(t, known(t), "impression_id")
    return MostPopular(known(t), counts).fit().recommend(n=5)


RING = "behaviors known buffer current"


@query("j2_ring_buffer", with_ctes(f"{RING} rec_ring", "SELECT * FROM rec_ring"))
def _(t):
    return RingBuffer(known(t), 10).fit().recommend(n=5)


@query(
    "j2_ring_buffer_newest",
    with_ctes("behaviors known", """
SELECT impression_id, impression_time, user_id, article_id, CAST(row_number() OVER (ORDER BY impression_time DESC) AS INTEGER) AS slot
FROM known QUALIFY slot <= 10"""),
)
def _(t):
    return RingBuffer(known(t), 10, keep="newest").fit().contents()


@query(
    "j2_ring_buffer_cold",
    with_ctes("behaviors known buffer", f"""
SELECT c.user_id, p.article_id, CAST(p.c AS DOUBLE) AS score, p.rank
FROM (SELECT DISTINCT user_id + 1000000 AS user_id FROM events) c CROSS JOIN ({popular('buffer')}) p"""),
)
def _(t):
    unseen = t.users.select((F.col("user_id") + 1000000).alias("user_id"))
    return RingBuffer(known(t), 10).fit().recommend(unseen, n=5)


@query(
    "j2_ring_buffer_add",
    with_ctes("behaviors known", """
SELECT impression_id, article_id FROM (
  SELECT impression_id, article_id, impression_time FROM known
  UNION ALL SELECT impression_id + 1000000000, article_id, impression_time + INTERVAL 1 YEAR FROM known WHERE article_id = 7) q
ORDER BY impression_time DESC, impression_id DESC LIMIT 10"""),
)
def _(t):
    rows = known(t)
    later = rows.where("article_id = 7").select(
        (F.col("impression_id") + 1000000000).alias("impression_id"),
        "article_id",
        F.expr("impression_time + INTERVAL 1 YEAR").alias("impression_time"),
        "user_id",
    )
    return RingBuffer(rows, 10, keep="newest").fit().add_behaviors(later).most_recent(10).select("impression_id", "article_id")


# New rows from the whole log, a month on or a year back, enter in time order and evict what came first.
APPENDED = """
SELECT impression_id, article_id, CAST(row_number() OVER (ORDER BY old, place) AS INTEGER) AS slot FROM (
  SELECT impression_id + 1000000000 AS impression_id, article_id, 0 AS old,
    row_number() OVER (ORDER BY impression_time DESC, impression_id DESC) AS place FROM known WHERE {picked}
  UNION ALL SELECT impression_id, article_id, 1 AS old, row_number() OVER (ORDER BY impression_time {order}, impression_id {order}) AS place FROM known
  QUALIFY place <= 10) q
QUALIFY slot <= 10"""


def appended(t, keep: str, picked: str, shift: str):
    rows = known(t)
    new = rows.where(picked).select(
        (F.col("impression_id") + 1000000000).alias("impression_id"),
        "article_id",
        F.expr(f"impression_time {shift}").alias("impression_time"),
        "user_id",
    )
    return RingBuffer(rows, 10, keep=keep).fit().add_behaviors(new).contents().select("impression_id", "article_id", "slot")


@query("j2_ring_buffer_add_oldest", with_ctes("behaviors known", APPENDED.format(order="", picked="true")))
def _(t):
    return appended(t, "oldest", "true", "+ INTERVAL 30 DAY")


@query("j2_ring_buffer_add_newest", with_ctes("behaviors known", APPENDED.format(order="DESC", picked="true")))
def _(t):
    return appended(t, "newest", "true", "+ INTERVAL 30 DAY")


@query(
    "j2_ring_buffer_add_late",
    with_ctes("behaviors known", APPENDED.format(
        order="", picked="impression_id = (SELECT max(impression_id) FROM known)")),
)
def _(t):
    # One row from before all others still takes the last slot.
    newest = known(t).agg(F.max("impression_id")).first()[0]
    return appended(t, "oldest", f"impression_id = {newest}", "- INTERVAL 10 YEAR")


# --- bias --------------------------------------------------------------------------


@query(
    "j3_bias_params",
    with_ctes(BIAS, """
SELECT 'user' AS kind, user_id AS id, round(user_bias, 6) AS bias FROM b_u
UNION ALL SELECT 'item', article_id, round(item_bias, 6) FROM b_i
UNION ALL SELECT 'mean', 0, round(mu, 6) FROM mu"""),
)
def _(t):
    m = UserItemBias(scored(t)).fit()
    users = m.user_biases.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), rounded("user_bias", "bias"))
    items = m.item_biases.select(F.lit("item").alias("kind"), F.col("article_id").alias("id"), rounded("item_bias", "bias"))
    mean = users.agg(F.lit("mean").alias("kind"), F.lit(0).cast("long").alias("id"), F.round(F.lit(m.global_mean), 6).alias("bias"))
    return users.unionByName(items).unionByName(mean)


@query("j3_bias_recommend", with_ctes(f"{BIAS} rec_bias", RECS + "rec_bias"))
def _(t):
    return recs(UserItemBias(scored(t)).fit().recommend(n=5))


@query(
    "j3_bias_predict",
    with_ctes(BIAS, """
SELECT k.impression_id, round(mu + user_bias + item_bias, 6) AS score
FROM known k JOIN b_u USING (user_id) JOIN b_i USING (article_id) CROSS JOIN mu"""),
)
def _(t):
    m = UserItemBias(scored(t)).fit()
    return m.predict(known(t).select("impression_id", "user_id", "article_id")).select("impression_id", rounded("score", "score"))


@query(
    "j3_user_ratings",
    with_ctes(f"{SCORED} cells", """
SELECT u.user_id, i.article_id, round(coalesce(c.rating, 0), 6) AS rating
FROM (SELECT DISTINCT user_id FROM cells) u CROSS JOIN (SELECT DISTINCT article_id FROM cells) i
LEFT JOIN cells c ON c.user_id = u.user_id AND c.article_id = i.article_id"""),
)
def _(t):
    ratings = UserItemBias(scored(t)).fit().user_ratings(t.users, dense=True)
    return ratings.select("user_id", "article_id", rounded("rating", "rating"))


# --- collaborative models ----------------------------------------------------------

INTER = "behaviors known inter s"


@query("j4_user_cf_neighbors", with_ctes(f"{INTER} unit_u nb_u", NB + "nb_u"))
def _(t):
    return pairs(UserCF(inter(t)).fit().neighbors)


@query("j4_user_cf_recommend", with_ctes(f"{INTER} unit_u nb_u rec_u", LOG_RECS + "rec_u"))
def _(t):
    return log_recs(UserCF(inter(t)).fit().recommend(n=5))


@query("j4_user_cf_binary", with_ctes(f"{INTER} s_bin unit_u_bin nb_u_bin rec_u_bin", RECS + "rec_u_bin"))
def _(t):
    return recs(UserCF(inter(t), binary_model=True).fit().recommend(n=5))


BIG = "big inter_big s_big"


@query("j4_user_cf_neighbors_big", with_ctes(f"{BIG} unit_u_big nb_u_big", NB + "nb_u_big"))
def _(t):
    return pairs(UserCF(inter_big(t)).fit(0.1, 1.0).neighbors)


@query("j4_user_cf_recommend_big", with_ctes(f"{BIG} unit_u_big nb_u_big rec_u_big", LOG_RECS + "rec_u_big"))
def _(t):
    return log_recs(UserCF(inter_big(t)).fit(0.1, 1.0).recommend(n=5))


@query("j5_item_cf_neighbors", with_ctes(f"{INTER} unit_i nb_i", NB + "nb_i"))
def _(t):
    return pairs(ItemCF(inter(t)).fit().neighbors)


@query("j5_item_cf_recommend", with_ctes(f"{INTER} unit_i nb_i rec_i", RECS + "rec_i"))
def _(t):
    return recs(ItemCF(inter(t)).fit().recommend(n=5))


@query("j5_item_cf_binary", with_ctes(f"{INTER} s_bin unit_i_bin nb_i_bin rec_i_bin", RECS + "rec_i_bin"))
def _(t):
    return recs(ItemCF(inter(t), binary_model=True).fit().recommend(n=5))


@query("j5_item_cf_neighbors_big", with_ctes(f"{BIG} unit_i_big nb_i_big", NB + "nb_i_big"))
def _(t):
    return pairs(ItemCF(inter_big(t)).fit(0.1, 1.0).neighbors)


@query("j5_item_cf_recommend_big", with_ctes(f"{BIG} unit_i_big nb_i_big rec_i_big", RECS + "rec_i_big"))
def _(t):
    return recs(ItemCF(inter_big(t)).fit(0.1, 1.0).recommend(n=5))


TOPICS = f"{INTER} topics topic_rows unit_t nb_t"


@query("j6_topic_neighbors", with_ctes(f"topics topic_rows unit_t nb_t", NB + "nb_t"))
def _(t):
    return pairs(TopicCF(inter(t), t.topics).fit().neighbors)


def topic_walk(liking: str, n: int = 5) -> str:
    """The walk down a user's articles that ends once n candidates are known."""
    return f"""
SELECT user_id, article_id, sum(liking * sim) AS score FROM (
  SELECT o.*, min(CASE WHEN o.so_far >= {n} THEN o.step END) OVER (PARTITION BY user_id) AS stop
  FROM (SELECT x.*, sum(x.fresh) OVER (PARTITION BY user_id ORDER BY step RANGE UNBOUNDED PRECEDING) AS so_far
        FROM (SELECT a.user_id, nb.neighbor AS article_id, a.step, a.liking, nb.sim,
                (row_number() OVER (PARTITION BY a.user_id, nb.neighbor ORDER BY a.step) = 1)::INT AS fresh
              FROM (SELECT user_id, article_id, {liking} AS liking,
                      row_number() OVER (PARTITION BY user_id ORDER BY round({liking}, 9) DESC, article_id) AS step FROM s) a
              JOIN nb_t nb ON nb.entity = a.article_id
              WHERE NOT EXISTS (SELECT 1 FROM s d WHERE d.user_id = a.user_id AND d.article_id = nb.neighbor)) x) o) w
WHERE stop IS NULL OR step <= stop GROUP BY user_id, article_id"""


@query(
    "j6_topic_cf_recommend",
    with_ctes(TOPICS, LOG_RECS + f"({oracle.top(topic_walk('coalesce(v, 0)'))}) r"),
)
def _(t):
    return log_recs(TopicCF(inter(t), t.topics).fit().recommend(n=5))


@query("j6_topic_cf_binary", with_ctes(TOPICS, RECS + f"({oracle.top(topic_walk('1.0::DOUBLE'))}) r"))
def _(t):
    return recs(TopicCF(inter(t), t.topics, binary_model=True).fit().recommend(n=5))


HYBRID = f"""
SELECT user_id, article_id, CAST(rank AS INTEGER) AS rank, CASE WHEN score > 0 THEN round(ln(1 + score), 6) ELSE score END AS score FROM (
  SELECT user_id, article_id, score, row_number() OVER (PARTITION BY user_id ORDER BY source, place) AS rank FROM (
    SELECT user_id, article_id, 0 AS source, rank AS place, CAST(score AS DOUBLE) AS score FROM own
    UNION ALL
    SELECT u.user_id, p.article_id, 1, p.rank, CAST(-p.rank AS DOUBLE)
    FROM who u CROSS JOIN ({popular('inter', 100)}) p
    WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = u.user_id AND o.article_id = p.article_id)) c) r
WHERE rank <= 60"""


def hybrid_recs(df: DataFrame) -> DataFrame:
    """Collaborative scores on a log scale; those of popular articles are minus their rank."""
    score = F.when(F.col("score") > 0, F.log1p("score")).otherwise(F.col("score"))
    return df.select("user_id", "article_id", "rank", rounded(score, "score"))


@query(
    "j7_hybrid_recommend",
    with_ctes(f"{INTER} unit_u nb_u", HYBRID).replace(
        "\nSELECT user_id, article_id, CAST(rank",
        ",\nown AS (" + oracle.top(oracle.user_cf_scores("u", "s"), 60) + "),\n"
        "who AS (SELECT DISTINCT user_id FROM inter UNION SELECT 1000000 + user_id FROM inter)\n"
        "SELECT user_id, article_id, CAST(rank",
        1,
    ),
)
def hybrid_with_fill(t):
    return long_hybrid(t, None)


def long_hybrid(t, counts):
    model = PopularityUserCF(inter(t), counts=counts).fit()
    everyone = inter(t).select("user_id")
    who = everyone.union(everyone.select(F.col("user_id") + 1000000))
    # Lists of 60 are longer than what the neighbours offer, so the fill is reached.
    return hybrid_recs(model.recommend(who, n=60))


@query("j7_hybrid_from_loads", ORACLES["j7_hybrid_recommend"])
def _(t):
    return long_hybrid(t, experiments.loaded_counts(t, inter(t).select("user_id", "article_id"), "user_id"))


@query(
    "j7_hybrid_recommend_big",
    with_ctes(f"{BIG} unit_u_big nb_u_big", HYBRID.replace("rank <= 60", "rank <= 5").replace("FROM inter ", "FROM inter_big ")).replace(
        "\nSELECT user_id, article_id, CAST(rank",
        ",\nown AS (" + oracle.top(oracle.user_cf_scores("u_big", "s_big")) + "),\n"
        "who AS (SELECT DISTINCT user_id FROM inter_big)\n"
        "SELECT user_id, article_id, CAST(rank",
        1,
    ),
)
def _(t):
    return hybrid_recs(PopularityUserCF(inter_big(t)).fit(0.1, 1.0).recommend(n=5))


# --- content models ----------------------------------------------------------------


@query("j8_weighted_profile_recommend", with_ctes(f"{PROFILE} rec_profile", RECS + "rec_profile"))
def _(t):
    return recs(WeightedProfiles(scored(t), t.vectors).fit().recommend(n=5))


@query(
    "j8_pair_score",
    with_ctes(f"{PROFILE} user_test", """
SELECT x.user_id, x.article_id, round(s.score, 6) AS score
FROM user_test x JOIN profile_scores s ON s.user_id = x.user_id AND s.article_id = x.article_id"""),
)
def _(t):
    model = WeightedProfiles(scored(t), t.vectors).fit()
    return model.score(model.test.select("user_id", "article_id")).select("user_id", "article_id", rounded("score", "score"))


@query(
    "j9_cosine_recommend",
    with_ctes("behaviors known dims norms cos_profiles cos_norms rec_cos", RECS + "rec_cos"),
)
def _(t):
    return recs(CosineProfiles(known(t), t.articles, t.vectors).fit().recommend(n=5))


@query("j10_click_model")
def _(t):
    model = ClickModel(t.behaviors, t.users, t.articles, t.vectors).fit()
    return recs(model.recommend(n=5))


COMPONENTS = 20


@query(
    "j10_click_model_checks",
    with_ctes("behaviors known articles", f"""
SELECT 'components' AS what, CAST({COMPONENTS} AS BIGINT) AS n, true AS holds
UNION ALL SELECT 'coefficients', {COMPONENTS} + 1, true
UNION ALL SELECT 'pairs', (SELECT count(*) FROM known JOIN articles USING (article_id))
  + (SELECT count(DISTINCT user_id) FROM events) * (SELECT count(*) FROM articles)
  - (SELECT count(*) FROM (SELECT DISTINCT user_id, article_id FROM known JOIN articles USING (article_id)) p), true
UNION ALL SELECT 'recommended', CAST(sum(least(5, (SELECT count(*) FROM articles) - coalesce(seen, 0))) AS BIGINT), true
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(DISTINCT article_id) AS seen
  FROM known JOIN articles USING (article_id) GROUP BY user_id) s USING (user_id)"""),
)
def _(t):
    """What determines the fit: eigenvectors, a vanishing gradient, the weights, and the order of the lists."""
    model = ClickModel(t.behaviors, t.users, t.articles, t.vectors, n_components=COMPONENTS).fit(max_iter=500)
    counts = interactions.click_counts(t.behaviors, t.users, t.articles).join(model.features, "article_id")
    # The covariance once more, in SQL: (i, j, sum of weighted products), less the means.
    weight = (F.col("positives") + F.col("negatives")).cast("double")
    cells = counts.select(weight.alias("w"), F.posexplode("features").alias("i", "x"), "features").select(
        "w", "i", "x", F.posexplode("features").alias("j", "y")
    )
    sums = cells.groupBy("i", "j").agg(
        F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("w") * F.col("x")).alias("xs"),
        F.sum(F.col("w") * F.col("y")).alias("ys"), F.sum("w").alias("ws"),
    ).toPandas().sort_values(["i", "j"])
    total = float(sums["ws"].iloc[0])
    d = model.components.shape[0]
    shape = lambda c: sums[c].to_numpy().reshape(d, d) / total
    covariance = shape("xy") - shape("xs") * shape("ys")
    v = model.components
    values = np.einsum("ij,ij->j", v, covariance @ v)
    largest = np.sort(np.linalg.eigvalsh(covariance))[::-1][:COMPONENTS]
    fits = (
        np.abs(covariance @ v - v * values).max() < 1e-6
        and np.abs(v.T @ v - np.eye(COMPONENTS)).max() < 1e-6
        and np.abs(values - largest).max() < 1e-6
    )
    # The gradient of the penalised mean loss at the coefficients, from the weighted examples.
    beta, bias = model.classifier.coefficients.toArray(), float(model.classifier.intercept)
    score = F.aggregate(
        F.zip_with("features", F.array(*[F.lit(float(b)) for b in beta]), lambda x, b: x * b), F.lit(bias), lambda a, x: a + x
    )
    slope = F.col("weight") * (1 / (1 + F.exp(-score)) - F.col("label"))
    parts = model.examples.select(slope.alias("g"), "weight", "features")
    steps = parts.select("g", F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.sum(F.col("g") * F.col("x")).alias("s"))
    sums_w = parts.agg(F.sum("weight"), F.sum("g")).first()
    gradient = steps.orderBy("i").toPandas()["s"].to_numpy() / sums_w[0] + PENALTY * beta
    flat = np.abs(gradient).max() < 1e-4 and abs(sums_w[1] / sums_w[0]) < 1e-4

    lists = pin(model.recommend(n=5))
    clicked = known(t).select("user_id", "article_id").distinct()
    ranked = model.ranked.select("article_id", "prediction", "position")
    wrong_order = ranked.alias("a").join(ranked.alias("b"), F.col("a.position") + 1 == F.col("b.position")).where(
        F.col("a.prediction") < F.col("b.prediction") - 1e-9
    )
    in_order = wrong_order.isEmpty() and lists.join(clicked, ["user_id", "article_id"], "left_semi").isEmpty()
    return t.spark.createDataFrame(
        [
            ("components", int(v.shape[1]), bool(fits)),
            ("coefficients", len(beta) + 1, bool(flat)),
            ("pairs", int(round(sums_w[0])), bool(abs(total - sums_w[0]) < 1e-6 * total)),
            ("recommended", lists.count(), bool(in_order)),
        ],
        "what string, n long, holds boolean",
    )


@query("j9_precomputed_ranking", with_ctes("behaviors known dims norms cos_profiles cos_norms rec_cos", RECS + "rec_cos WHERE rank <= 3"))
def _(t):
    # The ranking is made at the fit, five deep; recommending only cuts it.
    return recs(CosineProfiles(known(t), t.articles, t.vectors).fit(top_k=5).recommend(n=3))


@query(
    "j2_buffer_reads",
    with_ctes("behaviors known buffer", """
SELECT 'slot 3' AS what, impression_id AS value FROM buffer WHERE slot = 3
UNION ALL SELECT 'length', count(*) FROM buffer
UNION ALL SELECT 'cleared', 0
UNION ALL SELECT 'popular', article_id FROM (SELECT article_id FROM buffer GROUP BY article_id ORDER BY count(*) DESC, article_id LIMIT 1) p"""),
)
def _(t):
    model = RingBuffer(known(t), 10).fit()
    row = lambda df, what, column: df.select(F.lit(what).alias("what"), F.col(column).alias("value"))
    return (
        row(model.slot(3), "slot 3", "impression_id")
        .unionByName(row(model.length(), "length", "length"))
        .unionByName(row(model.cleared().length(), "cleared", "length"))
        .unionByName(row(model.most_popular(1), "popular", "article_id"))
    )


# --- metrics -----------------------------------------------------------------------

TIME_PARTS = "behaviors known by_time time_train time_test"
EVAL_POPULAR = f"rec AS ({popular_recs('time_train')})"


def _with_rec(ctes: str, rec: str, body: str) -> str:
    return with_ctes(ctes, body).replace("\n" + body, f",\nrec AS ({rec})\n" + body, 1)


def popular_on_time_split(t):
    train, test = splits.time_split(known(t), test_ratio=0.3)
    return MostPopular(train).fit().recommend(test, n=5), train, test


@query(
    "k1_user_metrics",
    _with_rec("behaviors known hash_train hash_test", popular_recs("hash_train"), f"""
SELECT user_id, relevant, returned, CAST(hits AS BIGINT) AS hits, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(fpr, 6) AS fpr, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM ({oracle.user_metrics('rec', 'hash_test')}) m"""),
)
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    rows = metrics.user_metrics(MostPopular(train).fit().recommend(n=5), test, 5)
    shown = [rounded(c, c) for c in ("precision", "recall", "fpr", "ndcg", "ap")]
    return rows.select("user_id", "relevant", "returned", "hits", *shown)


def _evaluation(df):
    return df.select(rounded("precision", "precision"), rounded("recall", "recall"), rounded("fpr", "fpr"), "users")


def _ranking(df):
    return df.select(
        rounded("precision_at_k", "precision_at_k"), rounded("map_at_k", "map_at_k"), rounded("ndcg_at_k", "ndcg_at_k"), "users"
    )


@query("k6_evaluate", _with_rec(TIME_PARTS, popular_recs("time_train"), evaluated("rec", "time_test")))
def _(t):
    found, _train, test = popular_on_time_split(t)
    return _evaluation(metrics.evaluate(found, test, 5))


@query(
    "k4_ndcg",
    _with_rec("behaviors known hash_train hash_test", popular_recs("hash_train"),
              f"SELECT ndcg_at_k, users FROM ({ranking_evaluated('rec', 'hash_test')}) e"),
)
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    return _ranking(metrics.evaluate_ranking(MostPopular(train).fit().recommend(n=5), test)).select("ndcg_at_k", "users")


CF_TRAIN = "SELECT article_id, user_id, coalesce(product(read_time), 1.0) AS total_readtime, max(scroll_percentage) AS max_scroll FROM {} GROUP BY article_id, user_id"


@query(
    "k5_map",
    with_ctes("behaviors known hash_train hash_test dims norms", """
SELECT map_at_k, users FROM (""" + ranking_evaluated("rec_cos", "hash_test") + ") e").replace(
        "\n\nSELECT map_at_k",
        ",\ncos_profiles AS (" + oracle.CTES["cos_profiles"].replace("FROM known k", "FROM hash_train k") + "),\n"
        "cos_norms AS (" + oracle.CTES["cos_norms"] + "),\nrec_cos AS (" + oracle.CTES["rec_cos"] + ")\nSELECT map_at_k",
        1,
    ),
)
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    model = CosineProfiles(train, t.articles, t.vectors).fit()
    return _ranking(metrics.evaluate_ranking(model.recommend(test, n=5), test)).select("map_at_k", "users")


SPLIT_SCORES = (
    "SELECT user_id, article_id, score FROM scored s WHERE user_id % 10 <> 3 AND EXISTS (SELECT 1 FROM hash_train h "
    "WHERE h.user_id = s.user_id AND h.article_id = s.article_id)"
)


def bias_on_split(body: str) -> str:
    """``body`` after the bias model of the train part without a tenth of the users."""
    cells = oracle.CTES["cells"].replace("FROM scored", f"FROM ({SPLIT_SCORES}) q")
    ctes = with_ctes(f"{SCORED} hash_train hash_test", "SELECT 1")
    rest = "".join(f",\n{n} AS ({oracle.CTES[n]})" for n in ("mu", "b_u", "b_i", "rec_bias"))
    return ctes.replace("\nSELECT 1", f",\ncells AS ({cells}){rest}\n{body}")


def bias_of_split(t) -> tuple[UserItemBias, DataFrame]:
    train, test = splits.random_split(known(t), 0.3)
    pairs = train.select("user_id", "article_id").distinct()
    return UserItemBias(scored(t).where("user_id % 10 <> 3").join(pairs, ["user_id", "article_id"], "left_semi")).fit(), test


@query(
    "k7_bias_metrics",
    bias_on_split(ranking_evaluated("rec_bias", "hash_test", users="b_u")),
)
def _(t):
    model, test = bias_of_split(t)
    return _ranking(metrics.evaluate_ranking(model.recommend(n=5), test, users=model.user_biases))


# A tenth of the users is unknown to the model: it isn't asked for them.
@query("k6_bias_evaluate", bias_on_split(evaluated("rec_bias", "hash_test", users="b_u")))
def _(t):
    model, test = bias_of_split(t)
    return _evaluation(experiments.evaluate_model(model, test, 5))


@query(
    "k6_profile_evaluate",
    with_ctes(f"{PROFILE} rec_profile user_test", "SELECT 1").replace(
        "\nSELECT 1", ",\nscorable AS (SELECT user_id FROM user_train GROUP BY user_id HAVING coalesce(sum(score), 1) <> 0)\n"
        + evaluated("rec_profile", "user_test", users="scorable"),
    ),
)
def _(t):
    model = WeightedProfiles(scored(t), t.vectors).fit()
    return _evaluation(experiments.evaluate_model(model, model.test, 5))


HASH_CF = "behaviors known hash_train hash_test"


@query(
    "k7_item_cf_metrics",
    with_ctes(HASH_CF, "CF").replace(
        "\nCF",
        ",\ng AS (" + CF_TRAIN.format("hash_train") + "),\ng_s AS (SELECT user_id, article_id, max_scroll * 0.1::DOUBLE + total_readtime AS v FROM g),\n"
        f"unit_g AS ({oracle.unit('g_s', 'article_id', 'user_id')}),\nnb_g AS ({oracle.neighbours('unit_g')}),\n"
        f"rec_g AS ({oracle.top(oracle.item_cf_scores('g', 'g_s'))})\n" + ranking_evaluated("rec_g", "hash_test", users="g"),
    ),
)
def _(t):
    log = known_with_reading(t)
    train, test = splits.random_split(log, 0.3)
    rolled = interactions.roll_up(train)
    found = ItemCF(rolled).fit(0.1, 1.0).recommend(n=5)
    return _ranking(metrics.evaluate_ranking(found, test, 5, users=rolled))


def known_with_reading(t: GivenTables) -> DataFrame:
    return t.behaviors.where("article_id IS NOT NULL").select(
        "impression_id", "user_id", "article_id", "read_time", "scroll_percentage"
    )


@query(
    "k7_profile_metrics",
    with_ctes(f"{PROFILE} rec_profile user_test", ranking_evaluated("rec_profile", "user_test")),
)
def _(t):
    model = WeightedProfiles(scored(t), t.vectors).fit()
    return _ranking(metrics.evaluate_ranking(model.recommend(model.test, n=5), model.test))


@query("k7_click_model_metrics")
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    model = ClickModel(train, t.users, t.articles, t.vectors).fit()
    return _ranking(metrics.evaluate_ranking(model.recommend(test, n=5), test, skip_empty=True))


@query(
    "k7_sampled_metrics",
    _with_rec("behaviors known hash_train hash_test", popular_recs("hash_train"),
              f"SELECT * FROM ({ranking_evaluated('rec', 'hash_test', users='picked')}) e").replace(
        ",\nrec AS (",
        f",\npicked AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM hash_test) u ORDER BY {oracle.hash_of('(user_id + 42)')}, user_id LIMIT 40),\nrec AS (",
        1,
    ),
)
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    return _ranking(metrics.evaluate_ranking(MostPopular(train).fit().recommend(n=5), test, user_sample=40))


@query(
    "k8_diversity",
    with_ctes(f"{INTER} unit_i nb_i rec_i", """
SELECT count(DISTINCT article_id) AS recommended, (SELECT count(*) FROM embeddings) AS catalogue,
  round(count(DISTINCT article_id) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) AS diversity FROM rec_i"""),
)
def _(t):
    found = metrics.aggregate_diversity(ItemCF(inter(t)).fit().recommend(n=5), t.articles)
    return found.select("recommended", "catalogue", rounded("diversity", "diversity"))


GINI = """
SELECT count(*) AS items, CAST(sum(c) AS BIGINT) AS recommendations,
  round(sum((2 * nth - n - 1) * c) / CAST(any_value(n) * sum(c) AS DOUBLE), 6) AS gini
FROM (SELECT c, row_number() OVER (ORDER BY c) AS nth, count(*) OVER () AS n
      FROM (SELECT e.vec_id, count(r.article_id) AS c FROM embeddings e LEFT JOIN {rec} r ON r.article_id = e.vec_id
            GROUP BY e.vec_id) q) g"""


@query("k9_gini", with_ctes(f"{INTER} unit_i nb_i rec_i", GINI.format(rec="rec_i")))
def _(t):
    found = metrics.gini(ItemCF(inter(t)).fit().recommend(n=5), t.articles)
    return found.select("items", "recommendations", rounded("gini", "gini"))


@query(
    "k8_sampled_diversity",
    with_ctes(f"{INTER} unit_i nb_i rec_i", f"""
SELECT count(DISTINCT article_id) AS recommended, (SELECT count(*) FROM embeddings) AS catalogue,
  round(count(DISTINCT article_id) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) AS diversity
FROM rec_i WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u
  ORDER BY {oracle.hash_of('(user_id + 42)')}, user_id LIMIT 20)"""),
)
def _(t):
    found = experiments.model_diversity(ItemCF(inter(t)).fit(), t.articles, t.users, 5, user_sample=20)
    return found.select("recommended", "catalogue", rounded("diversity", "diversity"))


@query("k9_popular_gini", _with_rec("behaviors known", popular_recs("known"), GINI.format(rec="rec")))
def _(t):
    found = experiments.model_gini(MostPopular(known(t)).fit(), t.articles, t.users, 5)
    return found.select("items", "recommendations", rounded("gini", "gini"))


@query(
    "k10_overlap",
    _with_rec("behaviors known hash_train hash_test", popular_recs("hash_train"), """
SELECT user_id, article_id, rank FROM rec r WHERE EXISTS (
  SELECT 1 FROM hash_test t WHERE t.user_id = r.user_id AND t.article_id = r.article_id)"""),
)
def _(t):
    train, test = splits.random_split(known(t), 0.3)
    return metrics.prediction_overlap(MostPopular(train).fit().recommend(n=5), test).select("user_id", "article_id", "rank")


@query(
    "k11_split_compare",
    with_ctes("behaviors known hash_train hash_test by_time time_train time_test", "SPLITS").replace(
        "\nSPLITS",
        f",\nrec_hash AS ({popular_recs('hash_train')}),\nrec_time AS ({popular_recs('time_train')})\n"
        f"SELECT 'random' AS split, * FROM ({evaluated('rec_hash', 'hash_test')}) a\n"
        f"UNION ALL SELECT 'time', * FROM ({evaluated('rec_time', 'time_test')}) b",
    ),
)
def _(t):
    rows = experiments.compare_splits(known(t), lambda train: MostPopular(train).fit())
    return rows.select("split", rounded("precision", "precision"), rounded("recall", "recall"), rounded("fpr", "fpr"), "users")


def _grid_oracle(side: str) -> str:
    """Four variants of item-CF, or of user-CF, on one random split of the interactions."""
    ids = ("article_id", "user_id") if side == "item" else ("user_id", "article_id")
    h = oracle.hash_of("(user_id * 1000 + article_id)")
    ctes = f"""{with_ctes('behaviors known inter', 'X')[:-2]},
tr AS (SELECT * FROM inter WHERE {h} >= 0.2::DOUBLE),
te AS (SELECT * FROM inter WHERE {h} < 0.2::DOUBLE),
g_s AS (SELECT user_id, article_id, max_scroll + total_readtime AS v FROM tr),
g_s_bin AS (SELECT user_id, article_id, 1.0::DOUBLE AS v FROM tr)"""
    parts = []
    for kind, source, name in (("g_w", "g_s", "weighted"), ("g_b", "g_s_bin", "binary")):
        ctes += f",\nunit_{kind} AS ({oracle.unit(source, *ids)})"
        ctes += f",\nnb_{kind} AS ({oracle.neighbours(f'unit_{kind}')})"
        for allowed in (False, True):
            rec = f"rec_{kind}_{int(allowed)}"
            if side == "item":
                scores = oracle.item_cf_scores(kind, source, allow_read=allowed)
            else:
                scores = oracle.user_cf_scores(kind, source, binary=name == "binary", allow_read=allowed)
            ctes += f",\n{rec} AS ({oracle.top(scores)})"
            parts.append(
                f"SELECT '{name}' AS model, {str(allowed).lower()} AS read_allowed, * FROM ({ranking_evaluated(rec, 'te', users='tr')}) x"
            )
    return ctes + "\n" + "\nUNION ALL ".join(parts)


def _grid(t: GivenTables, model: type) -> DataFrame:
    rows = inter(t).withColumn("row_key", F.col("user_id") * 1000 + F.col("article_id"))
    train, test = splits.random_split(rows, 0.2, key="row_key")
    measures = [rounded(c, c) for c in ("precision_at_k", "map_at_k", "ndcg_at_k")]
    return experiments.variant_grid(train, test, model).select("model", "read_allowed", *measures, "users")


@query("k12_grid", _grid_oracle("item"))
def _(t):
    return _grid(t, ItemCF)


@query("k12_grid_user_cf", _grid_oracle("user"))
def _(t):
    return _grid(t, UserCF)


@query(
    "a6_metric_log",
    _with_rec(TIME_PARTS, popular_recs("time_train"), f"""
SELECT 'most popular' AS model, m AS metric, v AS value FROM (
  SELECT unnest(['precision@k', 'recall@k', 'fpr@k']) AS m, unnest(["precision", recall, fpr]) AS v
  FROM ({evaluated('rec', 'time_test')}) e) q"""),
)
def _(t):
    found, _train, test = popular_on_time_split(t)
    log = MetricLog(t.spark, scratch(t.spark, "metrics"))
    log.append_frame(experiments.as_metric_rows(metrics.evaluate(found, test, 5), "most popular"))
    return log.read().select("model", "metric", rounded("value", "value"))


# --- streams -----------------------------------------------------------------------


@query(
    "m1_stream_buffer",
    with_ctes("behaviors known", """
SELECT impression_id, user_id, article_id, CAST(row_number() OVER (ORDER BY impression_time DESC, impression_id DESC) AS INTEGER) AS slot
FROM known QUALIFY slot <= 10"""),
)
def _(t):
    return experiments.stream_last_rows(t, 10).select("impression_id", "user_id", "article_id", "slot")


@query(
    "m2_stream_click_counts",
    with_ctes("behaviors known articles", """
SELECT a.article_id, count(k.user_id) AS positives,
  (SELECT count(DISTINCT user_id) FROM events) - count(DISTINCT k.user_id) AS negatives
FROM articles a LEFT JOIN known k USING (article_id) GROUP BY a.article_id"""),
)
def _(t):
    return experiments.stream_click_counts(t)


@query(
    "a7_coverage_and_gini_log",
    with_ctes(f"{INTER} unit_i nb_i rec_i", """
SELECT 'item cf' AS model, 'aggregate_diversity' AS metric,
  round(count(DISTINCT article_id) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) AS value FROM rec_i
UNION ALL SELECT 'item cf', 'gini_coefficient', gini FROM (""" + GINI.format(rec="rec_i") + ") g"),
)
def _(t):
    found = ItemCF(inter(t)).fit().recommend(n=5)
    log = MetricLog(t.spark, scratch(t.spark, "metrics"))
    log.append_coverage("item cf", metrics.aggregate_diversity(found, t.articles).first()["diversity"])
    log.append_gini("item cf", metrics.gini(found, t.articles).first()["gini"])
    return log.read().select("model", "metric", rounded("value", "value"))

