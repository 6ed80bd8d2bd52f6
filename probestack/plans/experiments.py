"""Experiments by name. Each only chooses two views of the same rows; scoring is one function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probestack.functions.vectors import one_hot
from probestack.operators.cca import cca_cv, fold_moments
from probestack.operators.sampling import quota_sample, stratified_folds


def _one_hot_view(reps: DataFrame, second: DataFrame) -> DataFrame:
    """second: (word, idx) and its size in every row as n."""
    joined = reps.join(second, reps["label"] == second["word"])
    n = second.agg(F.count("*")).first()[0]
    return joined.withColumn("v2", one_hot(F.col("idx"), n))


def _vector_view(reps: DataFrame, second: DataFrame) -> DataFrame:
    """second: (word, vec), by label."""
    return reps.join(second.select("word", F.col("vec").alias("v2")), reps["label"] == F.col("word"))


def _row_view(reps: DataFrame, second: DataFrame) -> DataFrame:
    """second: (row_id, vec), the same rows: other layers, another model's, or a filterbank's frames."""
    return reps.join(second.select("row_id", F.col("vec").alias("v2")), "row_id")


#: view chooser by experiment; dashes in a name are read as underscores, and a leading cca_ may be left out.
EXPERIMENTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "mel": _row_view,
    "intra": _row_view,
    "inter": _row_view,
    "phone": _one_hot_view,
    "word": _one_hot_view,
    "glove": _vector_view,
    "agwe": _vector_view,
    "semantic": _vector_view,
    "syntactic": _vector_view,
}


def views(experiment: str, reps: DataFrame, second: DataFrame, max_per_label: int | None = None) -> DataFrame:
    """row_id, label, layer, v1, v2. Rows without a second view are dropped; labels may be capped by a hash order."""
    name = experiment.replace("-", "_").removeprefix("cca_")
    if name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {experiment!r}; known: {', '.join(EXPERIMENTS)}")
    rows = EXPERIMENTS[name](reps.withColumnRenamed("vec", "v1"), second)
    if max_per_label is not None:
        keep = quota_sample(rows.select("row_id", "label").distinct(), "label", max_per_label, ["row_id"])
        rows = rows.join(keep.select("row_id"), "row_id", "left_semi")
    return rows.select("row_id", "label", "layer", "v1", "v2")


def run_cca(experiment: str, reps: DataFrame, second: DataFrame, max_per_label: int | None = None, seed: str = "0", folds: DataFrame | None = None, mean_of_views: bool = False) -> DataFrame:
    """layer, score, n_trials for every layer of reps (row_id, label, layer, vec), all in one job.

    folds (row_id, fold), as read_folds gives them, replace the folds drawn by seed.
    """
    rows = views(experiment, reps, second, max_per_label)
    if folds is None:
        folds = stratified_folds(rows.select("row_id", "label").distinct(), "label", "row_id", seed=seed).select("row_id", "fold")
    return cca_cv(fold_moments(rows.join(folds, "row_id"), ["layer"]), ["layer"], mean_of_views)
