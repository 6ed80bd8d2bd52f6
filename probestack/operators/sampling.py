"""Reproducible sampling: every draw is an order by a hash of seed and id."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probestack.operators.stats import rank_within, running_min


def hash_order(seed: str, *ids: str) -> list[Column]:
    key = F.concat_ws("-", F.lit(seed), *[F.col(c).cast("string") for c in ids])
    return [F.md5(key), *[F.col(c) for c in ids]]


#: Up to so many rows of a stratum each task keeps only its own first ones; more are numbered by range.
TASK_QUOTA = 1000


def quota_sample(df: DataFrame, stratum: str, quota: int | str, ids: list[str], seed: str = "0") -> DataFrame:
    """At most quota rows (a number or a column) of each stratum, without replacement, however many rows a stratum has."""
    order = hash_order(seed, *ids)
    if isinstance(quota, int) and quota <= TASK_QUOTA:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    else:
        ranked = rank_within(df, [stratum], order, "_rank")
    most = F.lit(quota) if isinstance(quota, int) else F.col(quota)
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def sample_n(df: DataFrame, n: int, ids: list[str], seed: str = "0") -> DataFrame:
    """n rows in all; a top-n, so no global sort."""
    return df.orderBy(*hash_order(seed, *ids)).limit(n)


class Preset(NamedTuple):
    drop: tuple[str, ...]
    least: int
    most: int


#: Quotas of the token-level samples, by token type, split kind and (words) number of types.
PHONE_TYPES = 39
PRESETS = {
    ("phone", "dev", None): Preset(("SIL",), 200, 200),
    ("phone", "train", None): Preset(("SIL",), 3000, 7000),
    ("word", "dev", None): Preset(("<unk>",), 15, 15),
    ("word", "train", 350): Preset(("<unk>",), 800, 1200),
    ("word", "train", 500): Preset(("<unk>",), 600, 1200),
}


def preset(token_type: str, split: str, n_words: int | None = None) -> Preset:
    kind = "train" if "train" in split else "dev"
    key = (token_type, kind, n_words if token_type == "word" and kind == "train" else None)
    if key not in PRESETS:
        raise ValueError(f"no quotas for {token_type} in {split} with {n_words} words; known: {sorted(map(str, PRESETS))}")
    return PRESETS[key]


def shrinking_quotas(counts: DataFrame, least: int, most: int, order: list[Column], seed: str = "0") -> DataFrame:
    """token, cnt, low, high, quota, in the order in which tokens are visited.

    Both bounds fall to the smallest count met so far and never rise again (the behaviour kept as it
    is observable); quota is drawn between them. For quotas that don't influence one another give
    low and high by `independent_quotas`. counts has one row per token type.
    """
    met = running_min(counts, order, "cnt", "_met")
    return _drawn(met.withColumn("low", F.least(F.lit(least), "_met")).withColumn("high", F.least(F.lit(most), "_met")).drop("_met"), seed)


def independent_quotas(counts: DataFrame, least: int, most: int, seed: str = "0") -> DataFrame:
    return _drawn(counts.withColumn("low", F.least(F.lit(least), "cnt")).withColumn("high", F.least(F.lit(most), "cnt")), seed)


def token_sample(rows: DataFrame, token_type: str, split: str, ids: list[str], n_words: int | None = None, seed: str = "0") -> DataFrame:
    """The token-level sample of rows (token, ids) by its preset: rows with the token's cnt and quota.

    Tokens that the preset drops are left out; words are the n_words most frequent others, phones all.
    Tokens are visited by falling count, as their lists are ordered. In training splits the bounds shrink
    on the way (shrinking_quotas) and a quota is drawn between them; in others a token gives as many rows
    as it has, up to the preset's bound, whatever the tokens before it had.
    """
    chosen = preset(token_type, split, n_words)
    counts = rows.where(~F.col("token").isin(*chosen.drop)).groupBy("token").agg(F.count("*").alias("cnt"))
    order = [F.desc("cnt"), F.col("token")]
    if token_type == "word" and n_words is not None:
        counts = counts.orderBy(*order).limit(n_words)
    if "train" in split:
        quotas = shrinking_quotas(counts, chosen.least, chosen.most, order, seed)
    else:
        quotas = counts.withColumn("quota", F.least(F.lit(chosen.least), "cnt"))
    return quota_sample(rows.join(quotas.select("token", "cnt", "quota"), "token"), "token", "quota", ids, seed)


def _drawn(df: DataFrame, seed: str) -> DataFrame:
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("token"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("quota", F.col("low") + F.pmod(draw, F.col("high") - F.col("low") + 1))


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int = 10, seed: str = "0") -> DataFrame:
    """A fold from 0 for each row, labels spread evenly; every fold exists however small a label is."""
    start = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(label).cast("string"))), 1, 8), 16, 10).cast("long")
    ranked = rank_within(df, [label], hash_order(seed, row_id), "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1 + start, F.lit(folds)).cast("int")).drop("_rank")
