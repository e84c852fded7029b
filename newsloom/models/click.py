"""Click probability of an article from its embedding: PCA, then logistic regression.

A pair's features depend on its article alone. The loss over all user-article pairs is
therefore the loss over two weighted rows per article, one for its clicked pairs and one
for the others, and the pairs themselves are never built. The same goes for the
covariance that the components come from: an article counts as often as it has pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import best_first
from newsloom.models.base import check_fitted, distinct_users
from newsloom.operators.clean import known_pairs
from newsloom.operators.interactions import click_counts
from newsloom.operators.ranking import best_unseen, global_rank
from newsloom.session import pin

# Fixed strength of the l2 penalty.
PENALTY = 1e-4


def weighted_examples(counts: DataFrame, features: DataFrame) -> DataFrame:
    """(article_id, label, weight, features): two rows per article, those of weight 0 left out."""
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("positives").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("negatives").cast("double").alias("weight")),
    )
    rows = counts.join(features, "article_id").select("article_id", "features", F.inline(both))
    return rows.where("weight > 0")


def weighted_moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, mean, covariance) of ``rows(features array<double>, weight)``.

    Each task sums its rows into one matrix of dimensions x dimensions; the driver adds those.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.array(batch["features"].tolist(), float)
                one = np.column_stack([np.ones(len(x)), x])
                part = (one * batch["weight"].to_numpy()[:, None]).T @ one
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    parts = rows.mapInPandas(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = parts.orderBy("place").toPandas()["value"].to_numpy()
    size = int(round(len(values) ** 0.5))
    moments = values.reshape(size, size)
    weight, mean = moments[0, 0], moments[0, 1:] / moments[0, 0]
    return weight, mean, moments[1:, 1:] / weight - np.outer(mean, mean)


def principal_components(covariance: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` directions of largest variance as columns, each with its largest entry positive."""
    _, vectors = np.linalg.eigh(covariance)
    chosen = vectors[:, ::-1][:, :k]
    largest = chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])]
    return chosen * np.where(largest < 0, -1.0, 1.0)


class ClickModel:
    def __init__(
        self,
        behaviors: DataFrame,
        users: DataFrame,
        articles: DataFrame,
        vectors: DataFrame,
        n_components: int = 50,
        vector: str = "document_vector",
    ):
        self.users = distinct_users(users)
        self.behaviors = behaviors
        self.articles = articles
        self.n_components = n_components
        self.features = vectors.select(
            F.col("article_id").cast("long").alias("article_id"),
            F.col(vector).cast("array<double>").alias("features"),
        ).where("features IS NOT NULL")
        self.ranked: DataFrame | None = None

    def fit(self, counts: DataFrame | None = None, max_iter: int = 100) -> "ClickModel":
        """``counts(article_id, positives, negatives)`` may come from a stream instead of the log."""
        if counts is None:
            counts = click_counts(self.behaviors, self.users, self.articles)
        per_article = counts.join(self.features, "article_id").select(
            "features", (F.col("positives") + F.col("negatives")).cast("double").alias("weight")
        )
        _, self.mean, self.covariance = weighted_moments(per_article)
        self.components = principal_components(self.covariance, self.n_components)
        reduced = pin(self.reduce(self.features))
        self.examples = pin(weighted_examples(counts, reduced.withColumnRenamed("reduced", "features")))
        rows = self.examples.withColumn("reduced", array_to_vector("features"))
        classify = LogisticRegression(
            featuresCol="reduced",
            labelCol="label",
            weightCol="weight",
            regParam=PENALTY,
            standardization=False,
            maxIter=max_iter,
        )
        self.classifier = classify.fit(rows)
        listed = self.articles.select(F.col("article_id").cast("long").alias("article_id")).distinct()
        known = reduced.join(listed, "article_id", "left_semi").withColumn("reduced", array_to_vector("reduced"))
        scored = self.classifier.transform(known).select(
            "article_id", F.get(vector_to_array("probability"), F.lit(1)).alias("prediction")
        )
        self.ranked = global_rank(scored, best_first("prediction", "article_id"))
        return self

    def reduce(self, features: DataFrame) -> DataFrame:
        """(article_id, reduced): the vectors, less their mean, along the components."""
        components, mean = self.components, self.mean

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.array(batch["features"].tolist(), float).reshape(len(batch), len(mean))
                yield pd.DataFrame({"article_id": batch["article_id"], "reduced": list((x - mean) @ components)})

        return features.select("article_id", "features").mapInPandas(project, "article_id long, reduced array<double>")

    def recommend(self, users: DataFrame | None = None, n: int = 5) -> DataFrame:
        """Articles the user has not clicked, by predicted probability; unknown users get no rows."""
        check_fitted(self, "ranked")
        who = self.users if users is None else self.users.join(distinct_users(users), "user_id", "left_semi")
        clicked = known_pairs(self.behaviors).join(who, "user_id", "left_semi")
        return best_unseen(who, self.ranked, clicked, n).select(
            "user_id", "article_id", F.col("prediction").alias("score"), F.col("rank").cast("int").alias("rank")
        )
