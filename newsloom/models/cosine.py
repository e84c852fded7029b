"""Unweighted profiles of normalised article embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import epoch_micros, l2_normalise
from newsloom.models.base import check_fitted, distinct_users
from newsloom.models.profile import mean_vectors
from newsloom.operators.vector_search import best_by_dot
from newsloom.session import pin

# Fixed columns of the items table that are not part of the embedding.
ARTICLE_FIELDS = ["article_id", "last_modified_time", "premium", "published_time", "category", "sentiment_score"]


def article_embeddings(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Article fields as numbers, joined with ``vec``, the embedding as one array.

    The embedding is the one column outside the fixed fields, or one column per
    dimension.
    """
    own = [c for c in ARTICLE_FIELDS if c in articles.columns]
    joined = articles.select(own).join(embeddings, "article_id")
    parts = [c for c in joined.columns if c not in ARTICLE_FIELDS]
    vec = F.col(parts[0]).cast("array<double>") if len(parts) == 1 else F.array(*[F.col(c).cast("double") for c in parts])

    def number(c: str):
        timed = dict(articles.dtypes)[c].startswith("timestamp")
        return epoch_micros(F.col(c)).cast("double") if timed else F.col(c).cast("double")

    fields = [number(c).alias(c) for c in own if c != "article_id"]
    return joined.select(F.col("article_id").cast("long").alias("article_id"), *fields, vec.alias("vec"))


class CosineProfiles:
    """Cosine to the mean of the normalised vectors of what a user has read; repeats count."""

    def __init__(self, train: DataFrame, articles: DataFrame, embeddings: DataFrame):
        self.train = train
        self.items = article_embeddings(articles, embeddings).select(
            "article_id", l2_normalise(F.col("vec")).alias("vec")
        ).where("vec IS NOT NULL")
        self.profiles: DataFrame | None = None
        self.rankings: DataFrame | None = None

    def fit(self, top_k: int | None = None) -> "CosineProfiles":
        """Profiles of all train users; with ``top_k`` also their first ``top_k`` items."""
        # Repeats become a weight before the vectors are joined.
        read = self.train.groupBy("user_id", F.col("article_id").cast("long").alias("article_id")).agg(
            F.count("*").cast("double").alias("times")
        )
        self.profiles = pin(mean_vectors(read.join(self.items, "article_id"), "user_id", "vec", "times"))
        if top_k is not None:
            self.rankings = pin(self._rank(self.user_vectors(self.train), top_k))
            self.ranked_depth = top_k
        return self

    def user_vectors(self, users: DataFrame) -> DataFrame:
        """(user_id, vec) of length one; a user without known articles has the zero vector."""
        check_fitted(self, "profiles")
        first = self.items.select(F.size("vec").alias("width")).first()
        zero = F.array_repeat(F.lit(0.0), first["width"] if first else 0)
        known = distinct_users(users).join(self.profiles, "user_id", "left")
        return known.select("user_id", l2_normalise(F.coalesce("vec", zero)).alias("vec"))

    def _rank(self, vectors: DataFrame, n: int, **limits: int) -> DataFrame:
        return best_by_dot(vectors, self.items, n, **limits)

    def recommend(self, users: DataFrame | None = None, n: int = 5, **limits: int) -> DataFrame:
        """The ``n`` best items; what a user has read is not left out."""
        check_fitted(self, "profiles")
        if self.rankings is not None and users is None and n <= self.ranked_depth:
            return self.rankings.where(F.col("rank") <= n)
        return self._rank(self.user_vectors(self.train if users is None else users), n, **limits)

    get_scores = recommend
