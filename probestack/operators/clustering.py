"""Clustered mutual information: k-means on training rows, assignments of evaluation rows against labels.

Two forms: kmeans_mi with centres that the library seeds, and lloyd for given centres and a fixed
number of rounds, whose result is a function of its input alone. Both use all rows in every round.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probestack.operators.pooling import vector_means
from probestack.operators.stats import assign_nearest, mutual_information
from probestack.shared import discard, scratch

#: Clusters by token type where none are given.
CLUSTERS = {"phone": 500, "word": 5000}


def kmeans_mi(train: DataFrame, evaluate: DataFrame, clusters: int, label: str = "label", vec: str = "vec", seed: int = 0, iterations: int = 20) -> DataFrame:
    """n, mi, h_label, nmi of the evaluation rows' clusters; nmi is mi over the labels' entropy."""
    as_features = lambda df: df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    features = as_features(train).select("features").persist()  # read once a round
    try:
        model = KMeans(k=clusters, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cluster").fit(features)
    finally:
        features.unpersist()
    found = mutual_information(model.transform(as_features(evaluate)).select(label, "cluster"), label, "cluster")
    return found.select("n", "mi", F.col("h_a").alias("h_label"), F.try_divide("mi", F.nullif("h_a", F.lit(0.0))).alias("nmi"))


def lloyd(rows: DataFrame, centres: DataFrame, rounds: int, vec: str = "vec") -> DataFrame:
    """cluster, vec, n: centres (cluster, vec) after some rounds of moving each to the mean of its nearest rows.

    A centre that no row is nearest to stays where it is (n 0). Ties go to the smallest cluster. A round is an
    aggregate that each task starts on its own rows; only centres are joined, and they are written each round.
    """
    now = scratch(centres.select("cluster", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).cast("long").alias("n")), "centres")
    for _ in range(rounds):
        moved = vector_means(assign_nearest(now, rows.select(vec), [], "cluster", vec), ["assigned"], vec)
        stay = now.select("cluster", F.col("vec").alias("old"))
        both = stay.join(moved, stay["cluster"] == moved["assigned"], "left")
        after = scratch(both.select("cluster", F.coalesce("vec", "old").alias("vec"), F.coalesce("n", F.lit(0)).cast("long").alias("n")), "centres")
        discard(now)
        now = after
    return now


def lloyd_mi(train: DataFrame, evaluate: DataFrame, centres: DataFrame, rounds: int, label: str = "label", vec: str = "vec") -> DataFrame:
    """n, mi, h_label, nmi of the evaluation rows' clusters after rounds of lloyd from given centres."""
    found = assign_nearest(lloyd(train, centres, rounds, vec), evaluate, [], "cluster", vec)
    mi = mutual_information(found.select(label, "assigned"), label, "assigned")
    return mi.select("n", "mi", F.col("h_a").alias("h_label"), F.try_divide("mi", F.nullif("h_a", F.lit(0.0))).alias("nmi"))
