"""Score-weighted profiles in document-vector space."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import cosine, l2_norm, l2_normalise
from newsloom.models.base import check_fitted, distinct_users
from newsloom.operators.clean import known_pairs
from newsloom.operators.splits import user_time_split
from newsloom.operators.vector_search import best_by_dot
from newsloom.session import pin


def mean_vectors(rows: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """(key, vec): the mean, or weighted mean, of array vectors per key.

    Summarizer keeps one running vector per key and merges partial ones from the map
    side, so a key with many rows is never gathered.
    """
    packed = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    mean = Summarizer.mean(F.col("_v"), F.col(weight)) if weight else Summarizer.mean(F.col("_v"))
    return packed.groupBy(key).agg(vector_to_array(mean).alias("vec"))


class WeightedProfiles:
    """Cosine to the score-weighted mean of a user's train articles.

    ``scored`` holds (user_id, article_id, impression_time, score); each user's oldest
    share of it is the train part. Rows without a score and articles without a vector
    take no part in a profile.
    """

    def __init__(self, scored: DataFrame, vectors: DataFrame, train_ratio: float = 0.8, vector: str = "document_vector"):
        self.train, self.test = user_time_split(scored, train_ratio)
        self.vectors = vectors.select(
            F.col("article_id").cast("long").alias("article_id"), F.col(vector).cast("array<double>").alias("vec")
        )
        self.profiles: DataFrame | None = None

    def fit(self) -> "WeightedProfiles":
        # The split's window feeds the profiles and the exclusions, so it is run once.
        self.train = pin(self.train)
        rated = self.train.where("score IS NOT NULL").select("user_id", "article_id", "score")
        totals = rated.groupBy("user_id").agg(F.sum("score").alias("total"))
        # A weighted mean of zeros does not exist: these users are reported, not ranked.
        self.errors = totals.where("total = 0").select("user_id")
        usable = rated.join(self.vectors, "article_id").where("score <> 0")
        self.profiles = pin(mean_vectors(usable, "user_id", "vec", "score"))
        return self

    def scorable(self, users: DataFrame) -> DataFrame:
        """The users without those whose train scores sum to zero."""
        return users.join(self.errors, "user_id", "left_anti")

    def default_profile(self) -> DataFrame:
        """(vec): the mean of all vectors, for users without train rows."""
        return mean_vectors(self.vectors.withColumn("all", F.lit(1)), "all", "vec").select("vec")

    def user_vectors(self, users: DataFrame | None = None) -> DataFrame:
        """(user_id, vec); a user without train rows gets the mean vector."""
        check_fitted(self, "profiles")
        if users is None:
            return self.profiles
        who = distinct_users(users).join(self.errors, "user_id", "left_anti")
        return who.join(self.profiles, "user_id", "left").select(
            "user_id", F.coalesce("vec", self.default_profile().scalar()).alias("vec")
        )

    def recommend(self, users: DataFrame | None = None, n: int = 5, **limits: int) -> DataFrame:
        """Items by cosine, without those rated in the train part."""
        wanted = self.user_vectors(users).where(l2_norm(F.col("vec")) > 0)
        items = self.vectors.where(l2_norm(F.col("vec")) > 0)
        return best_by_dot(
            wanted.select("user_id", l2_normalise(F.col("vec")).alias("vec")),
            items.select("article_id", l2_normalise(F.col("vec")).alias("vec")),
            n,
            exclude=known_pairs(self.train),
            **limits,
        )

    def score(self, pairs: DataFrame, strict: bool = False) -> DataFrame:
        """``pairs(user_id, article_id)`` with their cosine; unknown items dropped, or raise if ``strict``."""
        if strict:
            unknown = pairs.join(self.vectors, "article_id", "left_anti").select("article_id").first()
            if unknown is not None:
                raise ValueError(f"article {unknown[0]} has no vector")
        users = self.user_vectors(pairs).withColumnRenamed("vec", "profile")
        return (
            pairs.join(users, "user_id")
            .join(self.vectors, "article_id")
            .withColumn("score", cosine(F.col("profile"), F.col("vec")))
            .drop("profile", "vec")
        )
