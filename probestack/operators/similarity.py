"""Word-pair and sentence-pair similarity against human scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probestack.functions.vectors import cosine
from probestack.operators.stats import averages, spearman


def filter_pairs(pairs: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (task, w1, w2, score) both of whose words occur more than threshold times in counts (token, cnt)."""
    known = counts.where(F.col("cnt") > threshold).select("token")
    return pairs.join(known.withColumnRenamed("token", "w1"), "w1", "left_semi").join(known.withColumnRenamed("token", "w2"), "w2", "left_semi")


def retention(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """task, n_pairs, n_kept, fraction (2 places); tasks that keep nothing are reported with 0."""
    left = kept.groupBy("task").agg(F.count("*").alias("n_kept"))
    whole = pairs.groupBy("task").agg(F.count("*").alias("n_pairs")).join(left, "task", "left")
    n = F.coalesce("n_kept", F.lit(0))
    return whole.select("task", "n_pairs", n.alias("n_kept"), F.round(n / F.col("n_pairs"), 2).alias("fraction"))


def pair_cosines(pairs: DataFrame, embed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """pairs with cos; embed has (keys, word, vec). A pair with a missing word stays with cos null."""
    keys = keys or []
    a = embed.select(*keys, F.col("word").alias("w1"), F.col("vec").alias("v1"))
    b = embed.select(*keys, F.col("word").alias("w2"), F.col("vec").alias("v2"))
    joined = pairs.join(a, [*keys, "w1"], "left").join(b, [*keys, "w2"], "left")
    return joined.withColumn("cos", cosine("v1", "v2")).drop("v1", "v2")


def word_similarity(pairs: DataFrame, embed: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Spearman rho per task, and its micro and macro averages."""
    per = spearman(pair_cosines(pairs, embed, keys), "cos", "score", [*(keys or []), "task"])
    return per, averages(per)


def speaker_pairs(recordings: DataFrame) -> DataFrame:
    """pair_id, idx_a, idx_b: all speakers of side a with all of side b within a pair."""
    a = recordings.where("side = 'a'").select("pair_id", F.col("row_id").alias("idx_a"))
    b = recordings.where("side = 'b'").select("pair_id", F.col("row_id").alias("idx_b"))
    return a.join(b, "pair_id")


def gold_scores(rows: DataFrame) -> DataFrame:
    """pair_id, score, consistent: whether all rows of a pair agree on the human score."""
    return rows.groupBy("pair_id").agg(F.min("score").alias("score"), (F.min("score") == F.max("score")).alias("consistent"))


def sentence_similarity(pairs: DataFrame, gold: DataFrame, vectors: DataFrame, per_pair: int | None = 16, keys: list[str] | None = None) -> DataFrame:
    """keys, pair_id, cos, n, complete, score: cosines averaged over a pair's speaker pairs.

    complete says whether a pair has its per_pair speaker pairs (any number, if None); pairs that don't are
    reported, not dropped, and left out of the correlation.
    """
    keys = keys or []
    a = vectors.select(*keys, F.col("row_id").alias("idx_a"), F.col("vec").alias("va"))
    b = vectors.select(*keys, F.col("row_id").alias("idx_b"), F.col("vec").alias("vb"))
    scored = pairs.join(a, "idx_a").join(b, [*keys, "idx_b"]).select(*keys, "pair_id", cosine("va", "vb").alias("cos"))
    mean = scored.groupBy(*keys, "pair_id").agg(F.avg("cos").alias("cos"), F.count("*").alias("n"))
    return mean.withColumn("complete", F.lit(True) if per_pair is None else F.col("n") == per_pair).join(gold, "pair_id")


def sentence_rho(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, rho, n_incomplete: rank correlation of cosines and human scores over the complete pairs of each key (layer)."""
    keys = keys or []
    left = scored.groupBy(*keys).agg(F.count_if(~F.col("complete")).alias("n_incomplete"))
    rho = spearman(scored.where("complete"), "cos", "score", keys)
    return rho.join(left, keys, "right") if keys else rho.crossJoin(F.broadcast(left))  # one row
