"""The user-by-article matrix as bit-packed blocks: who read what, one bit a cell.

Users are numbered once. The readers of an article are words of 64 users each, built and combined by
Spark's bit aggregates, partly on the map side. A word has at least one reader, so there are never more words than
pairs, however thinly the readers are spread (Spark's own bitmaps of 4 KB each would be nearly empty then). Blocks of
several loads are merged by "or", so distinct readers stay exact without the log; "and" gives the readers that two
articles have in common. Blocks without a reader don't exist, and the matrix itself is only unrolled for users that are named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.models.base import distinct_users
from newsloom.operators.interactions import clicked_pairs, user_article_pairs
from newsloom.operators.ranking import global_rank
from newsloom.session import pin


# Users in one block: the bits of a long.
BLOCK_USERS = 64

# Block of a user's position, and the bit in it.
BLOCK = f"(position - 1) DIV {BLOCK_USERS} AS block"
BIT = f"CAST((position - 1) % {BLOCK_USERS} AS INT) AS bit"


def number_users(users: DataFrame) -> DataFrame:
    """(user_id, position) of the distinct users, from 1; the same numbers serve all loads."""
    return pin(global_rank(distinct_users(users), [F.col("user_id").asc()]))


@dataclass(frozen=True)
class ReaderBitmaps:
    """``places`` (user_id, position), ``blocks`` (article_id, block, bits, rows); ``rows`` counts impressions."""

    places: DataFrame
    blocks: DataFrame

    @classmethod
    def of(cls, behaviors: DataFrame, places: DataFrame) -> "ReaderBitmaps":
        """Blocks of one load. Users without a number and rows without a key are left out."""
        pairs = clicked_pairs(behaviors).groupBy("user_id", "article_id").agg(F.count("*").alias("rows"))
        blocks = (
            pairs.join(places, "user_id")
            .selectExpr("article_id", BLOCK, BIT, "rows")
            .groupBy("article_id", "block")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("rows").alias("rows"))
        )
        return cls(places, pin(blocks))

    def merged(self, other: "ReaderBitmaps") -> "ReaderBitmaps":
        """Both loads together; a reader of both counts once."""
        both = self.blocks.unionByName(other.blocks).groupBy("article_id", "block")
        return ReaderBitmaps(
            self.places, pin(both.agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows")))
        )

    def readers(self) -> DataFrame:
        """(article_id, positives, readers): impressions, and different users."""
        return self.blocks.groupBy("article_id").agg(
            F.sum("rows").alias("positives"), F.sum(F.bit_count("bits")).alias("readers")
        )

    def click_counts(self, articles: DataFrame) -> DataFrame:
        """(article_id, positives, negatives), as ``interactions.click_counts`` gives."""
        n_users = self.places.agg(F.count("*")).scalar()
        return (
            articles.select("article_id")
            .join(self.readers(), "article_id", "left")
            .na.fill(0, ["positives", "readers"])
            .select("article_id", "positives", (n_users - F.col("readers")).alias("negatives"))
        )

    def sparsity(self) -> DataFrame:
        """One row (interactions, users, items, sparsity) over the users and articles with a click."""
        n = self.blocks.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n"))
        any_article = self.blocks.groupBy("block").agg(F.bit_or("bits").alias("bits"))
        users = any_article.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).scalar()
        items = self.blocks.select("article_id").distinct().agg(F.count("*")).scalar()
        found = n.select(F.col("n").alias("interactions"), users.alias("users"), items.alias("items"))
        cells = F.col("users").cast("double") * F.col("items")
        return found.withColumn("sparsity", 1 - F.try_divide(F.col("interactions"), cells))

    def common_readers(self, pairs: DataFrame) -> DataFrame:
        """(first, second, readers) of the article pairs ``pairs`` (first, second): users who read both."""
        pairs = pairs.select("first", "second").distinct()
        sides = [pairs.withColumn("article_id", F.col(c)) for c in ("first", "second")]
        met = sides[0].unionByName(sides[1]).distinct().join(self.blocks, "article_id")
        # A block counts if it has both articles, or the one that is paired with itself.
        needed = F.when(F.col("first") == F.col("second"), 1).otherwise(2)
        both = met.groupBy("first", "second", "block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
        counted = both.where(F.col("n") == needed).groupBy("first", "second").agg(F.sum(F.bit_count("bits")).alias("readers"))
        return pairs.join(counted, ["first", "second"], "left").na.fill(0, ["readers"])

    def rows_of(self, users: DataFrame, articles: DataFrame) -> DataFrame:
        """(user_id, article_id, clicked): the literal cells of the named users, one a pair."""
        named = self.places.join(distinct_users(users), "user_id", "left_semi").selectExpr("user_id", BLOCK, BIT)
        is_set = F.expr("CAST(shiftright(bits, bit) & 1L AS INT)")
        clicks = self.blocks.join(named, "block").select("user_id", "article_id", is_set.alias("clicked"))
        pairs = user_article_pairs(named, articles.select("article_id").distinct())
        return pairs.join(clicks.where("clicked = 1"), ["user_id", "article_id"], "left").na.fill(0, ["clicked"])
