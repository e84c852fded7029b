"""From the impression log to user-item interaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import epoch_micros, log_read_score, min_max, unit_hash, weighted_score
from newsloom.operators.clean import (
    BEHAVIOR_CONTEXT,
    BEHAVIOR_FUTURE,
    BEHAVIOR_SPARSE,
    clean_train_and_validation,
    drop_missing_keys,
)
from newsloom.operators.ranking import best_unseen, global_rank
from newsloom.operators.reshape import distinct_labels, explode_labels, explode_parallel, wide_flags
from newsloom.session import pin

# Fixed weights of the interaction score.
ENGAGEMENT_SHARE = 0.8
FRESHNESS_SHARE = 0.2


def roll_up(behaviors: DataFrame, readtime_agg: str = "product") -> DataFrame:
    """One row per (article, user): combined read time and deepest scroll.

    Read times are multiplied, or summed with ``readtime_agg='sum'``; a pair without
    any read time counts 1, or 0 in a sum.
    """
    if readtime_agg == "product":
        total = F.coalesce(F.product("read_time"), F.lit(1.0))
    elif readtime_agg == "sum":
        total = F.coalesce(F.sum(F.col("read_time").cast("double")), F.lit(0.0))
    else:
        raise ValueError("readtime_agg is 'product' or 'sum'")
    return behaviors.groupBy("article_id", "user_id").agg(
        total.alias("total_readtime"), F.max("scroll_percentage").cast("double").alias("max_scroll")
    )


def roll_up_times(behaviors: DataFrame) -> DataFrame:
    """One row per (user, article): summed read time, deepest scroll, latest impression."""
    return behaviors.groupBy("user_id", "article_id").agg(
        F.coalesce(F.sum(F.col("read_time").cast("double")), F.lit(0.0)).alias("read_time"),
        F.max("scroll_percentage").cast("double").alias("scroll_percentage"),
        F.max("impression_time").alias("impression_time"),
    )


def collaborative_interactions(
    train: DataFrame, validation: DataFrame, readtime_agg: str = "product"
) -> DataFrame:
    """Both parts of the log, cleaned and rolled up, as the collaborative models read them."""
    unused = [c for c in BEHAVIOR_SPARSE + BEHAVIOR_FUTURE + BEHAVIOR_CONTEXT if c in train.columns]
    behaviors = clean_train_and_validation(
        train, validation, remove_columns=unused, filter_null_columns=["article_id"]
    )
    return roll_up(behaviors, readtime_agg)


def interaction_scores(behaviors: DataFrame, articles: DataFrame) -> DataFrame:
    """(user_id, article_id, impression_time, score): engagement and article freshness.

    Both parts are min-max scaled over their whole table. The rolled-up pairs are
    pinned, so that finding their extremes does not read the log again; the extremes
    are scalar subqueries. The score is null where the scroll is never known, the article is not
    listed, or a range is empty.
    """
    pairs = pin(
        roll_up_times(drop_missing_keys(behaviors, ["article_id", "user_id"])).select(
            "user_id",
            "article_id",
            "impression_time",
            log_read_score(F.col("read_time"), F.col("scroll_percentage")).alias("engagement"),
        )
    )
    ages = articles.select("article_id", epoch_micros(F.col("published_time")).alias("age"))
    low_e, high_e = pairs.agg(F.min("engagement")).scalar(), pairs.agg(F.max("engagement")).scalar()
    low_a, high_a = ages.agg(F.min("age")).scalar(), ages.agg(F.max("age")).scalar()
    fresh = ages.select("article_id", min_max(F.col("age"), low_a, high_a).alias("freshness"))
    score = min_max(F.col("engagement"), low_e, high_e) * F.lit(ENGAGEMENT_SHARE) + F.col("freshness") * F.lit(
        FRESHNESS_SHARE
    )
    return pairs.join(fresh, "article_id", "left").select(
        "user_id", "article_id", "impression_time", score.alias("score")
    )


def weighted_interactions(
    interactions: DataFrame, scroll_weight: float = 1.0, readtime_weight: float = 1.0
) -> DataFrame:
    """``interactions`` with ``interaction_score``; null where the scroll is unknown."""
    return interactions.withColumn(
        "interaction_score",
        weighted_score(F.col("max_scroll"), F.col("total_readtime"), scroll_weight, readtime_weight),
    )


def clicked_pairs(behaviors: DataFrame) -> DataFrame:
    """(user_id, article_id, clicked) with one row per impression of a known pair."""
    return drop_missing_keys(behaviors.select("user_id", "article_id"), ["user_id", "article_id"]).withColumn(
        "clicked", F.lit(1)
    )


# Ids in one catalogue block of the user-by-article grid.
GRID_BLOCK_IDS = 1024
# Pairs that one task unrolls, about.
TASK_PAIRS = 2_000_000


def _block(n_blocks: int):
    return F.pmod(F.xxhash64(F.col("article_id").cast("long")), F.lit(n_blocks)).cast("int")


def _grid(users: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(user, block number) rows, (block number, article ids) rows, and the number of blocks.

    Articles fall into blocks by hash, about GRID_BLOCK_IDS ids each; users meet blocks,
    not articles, so what is shuffled is smaller than the product by the block size.
    """
    n_blocks = max(1, -(-articles.count() // GRID_BLOCK_IDS))
    block = _block(n_blocks)
    blocks = articles.groupBy(block.alias("block")).agg(F.collect_list("article_id").alias("ids"))
    numbers = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    return users.select("user_id", F.explode(numbers).alias("block")), blocks, n_blocks


def user_article_pairs(users: DataFrame, articles: DataFrame) -> DataFrame:
    """Every (user_id, article_id) pair; unrolled from blocks in the last step."""
    grid, blocks, n_blocks = _grid(users, articles)
    return _met(grid, blocks, users.count(), n_blocks).select("user_id", F.explode("ids").alias("article_id"))


def _met(grid: DataFrame, blocks: DataFrame, n_users: int, n_blocks: int) -> DataFrame:
    """``grid`` (user_id, block, ...) with the ``ids`` of its block, in tasks of about TASK_PAIRS pairs.

    Grid rows are small and unroll to GRID_BLOCK_IDS rows each. By its bytes AQE would broadcast the grid, or
    merge it into few tasks; so both sides are dealt to a fixed number of tasks, and blocks are copied for them.
    """
    tasks = max(1, -(-n_users * n_blocks * GRID_BLOCK_IDS // TASK_PAIRS))
    copies = -(-tasks // n_blocks)
    dealt = grid.withColumn("_deal", F.pmod(F.xxhash64("user_id"), F.lit(copies)).cast("int"))
    copied = blocks.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    sides = [x.repartition(tasks, "block", "_deal") for x in (dealt, copied)]
    return sides[0].join(sides[1].hint("shuffle_hash"), ["block", "_deal"]).drop("_deal")


def binary_matrix(
    behaviors: DataFrame, users: DataFrame, articles: DataFrame, negatives_per_user: int | None = None
) -> DataFrame:
    """(user_id, article_id, clicked): every user against every article.

    The result itself has users x articles rows, and repeated impressions repeat their
    pair. Clicks are folded into a map per (user, block) and meet the block there, so
    the unrolled rows are never shuffled. No model here reads this table: the click
    model works on ``click_counts``. With ``negatives_per_user`` only that many
    unclicked articles are drawn per user, and the product is never built.
    """
    if negatives_per_user is not None:
        return _with_drawn_negatives(behaviors, users, articles, negatives_per_user)
    grid, blocks, n_blocks = _grid(users, articles)
    block = _block(n_blocks)
    # A user's clicks inside one block: at most the block's ids, whatever the log holds.
    clicks = (
        clicked_pairs(behaviors)
        .join(articles.select("article_id"), "article_id", "left_semi")
        .groupBy("user_id", "article_id")
        .agg(F.count("*").alias("times"))
        .groupBy("user_id", block.alias("block"))
        .agg(F.map_from_entries(F.collect_list(F.struct("article_id", "times"))).alias("clicks"))
    )
    times = F.coalesce(F.try_element_at("clicks", F.col("article_id")), F.lit(0).cast("long"))
    matrix = (
        _met(grid.join(clicks, ["user_id", "block"], "left"), blocks, users.count(), n_blocks)
        .select("user_id", "clicks", F.explode("ids").alias("article_id"))
        .select("user_id", "article_id", times.alias("times"))
        .select(
            "user_id",
            "article_id",
            F.least("times", F.lit(1)).cast("int").alias("clicked"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("times", F.lit(1)))).alias("_copy"),
        )
        .drop("_copy")
    )
    return matrix


def _with_drawn_negatives(behaviors: DataFrame, users: DataFrame, articles: DataFrame, n: int) -> DataFrame:
    """Clicked pairs, and for each user ``n`` unclicked articles (all, if there are fewer).

    The catalogue is a circle in the order of its ids; a user starts at a place that hashes
    the id and takes the first ``n`` articles that the user has not clicked. By the
    positions clicked, that is what ``best_unseen`` finds without walking the circle: the
    part from the start to the end of the circle, and then, if that has too few, the rest.
    """
    listed = articles.select("article_id").distinct()
    who = users.select("user_id").distinct()
    ranked = pin(global_rank(listed, [F.col("article_id").asc()]))
    size = ranked.count()
    clicked = clicked_pairs(behaviors).join(listed, "article_id", "left_semi")
    rows = clicked.join(who, "user_id", "left_semi").select("user_id", "article_id", F.lit(1).alias("clicked"))
    if not size or n <= 0:
        return rows
    start = F.floor(unit_hash(F.col("user_id")) * F.lit(size)).cast("long")
    # A user's own numbering of the circle: 1 at the start.
    own = F.pmod(F.col("position") - 1 - F.col("start"), F.lit(size)) + 1
    starts = who.withColumn("start", start)
    places = rows.select("user_id", "article_id").distinct().join(ranked, "article_id")
    taken = places.join(starts, "user_id").select("user_id", own.alias("position"))
    # Numbers of the circle as items: a row per place, of which only the first ones are used.
    numbers = ranked.select("position", F.col("position").alias("article_id"))
    free = best_unseen(who, numbers, taken.select("user_id", F.col("position").alias("article_id")), n)
    found = free.join(starts, "user_id").select(
        "user_id", (F.pmod(F.col("article_id") - 1 + F.col("start"), F.lit(size)) + 1).alias("position")
    )
    drawn = found.join(ranked, "position").select("user_id", "article_id", F.lit(0).alias("clicked"))
    return rows.unionByName(drawn)


def click_counts(behaviors: DataFrame, users: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, positives, negatives): row counts of the binary matrix per article.

    Counted without building the matrix: an article has one negative row for each user
    who never saw it.
    """
    known = (
        clicked_pairs(behaviors)
        .join(users.select("user_id").distinct(), "user_id", "left_semi")
        .groupBy("article_id", "user_id")
        .agg(F.count("*").alias("rows"))
        .groupBy("article_id")
        .agg(F.sum("rows").alias("positives"), F.count("*").alias("readers"))
    )
    n_users = users.agg(F.countDistinct("user_id")).scalar()
    return (
        articles.select("article_id")
        .join(known, "article_id", "left")
        .na.fill(0, ["positives", "readers"])
        .select("article_id", "positives", (n_users - F.col("readers")).alias("negatives"))
    )


def history_interactions(history: DataFrame) -> DataFrame:
    """(user_id, article_id, score): read time summed over the click history's parallel lists."""
    rows = explode_parallel(
        history.select("user_id", "article_id_fixed", "read_time_fixed"), ["article_id_fixed", "read_time_fixed"]
    )
    return (
        rows.where(F.col("article_id_fixed").isNotNull())
        .groupBy("user_id", F.col("article_id_fixed").alias("article_id"))
        .agg(F.coalesce(F.sum(F.col("read_time_fixed").cast("double")), F.lit(0.0)).alias("score"))
    )


# Fixed columns that the topic table leaves out.
ARTICLE_TEXT = [
    "title",
    "subtitle",
    "body",
    "url",
    "image_ids",
    "ner_clusters",
    "entity_groups",
    "article_type",
    "category_str",
    "sentiment_label",
    "last_modified_time",
    "published_time",
    "total_inviews",
    "total_pageviews",
    "total_read_time",
]


def article_topics(articles: DataFrame) -> DataFrame:
    """Long form (article_id, topic) of the topics list; null for an empty list."""
    return explode_labels(articles, "article_id", "topics", "topic")


def topic_features(
    articles: DataFrame, topics: DataFrame | None = None, values: list | None = None, most: int = 5000
) -> DataFrame:
    """Articles without their text, times and totals, premium as 0/1, and a 0/1 column per topic.

    ``topics`` is the long form; it is taken from the articles' own list if not given. Without
    ``values`` the topics are listed first; more than ``most`` raise, as they are columns here.
    """
    long = topics if topics is not None else article_topics(articles)
    labels = values if values is not None else distinct_labels(long, "topic", most)
    flags = wide_flags(long, "article_id", "topic", labels, "topic_")
    unused = [c for c in [*ARTICLE_TEXT, "topics", "subcategory"] if c in articles.columns]
    base = articles.drop(*unused)
    if "premium" in base.columns:
        base = base.withColumn("premium", F.col("premium").cast("int"))
    return base.join(flags, "article_id")


def long_topics(wide: DataFrame, prefix: str = "topic_") -> DataFrame:
    """Long form (article_id, topic) of a table with 0/1 topic columns."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    listed = F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c[len(prefix):])) for c in names])
    return wide.select("article_id", F.explode(F.array_compact(listed)).alias("topic"))


def items_with_vectors(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items table: every article with its document vector, null where there is none."""
    return articles.join(vectors, "article_id", "left")
