"""Token counts, vocabularies, splits and word lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probestack.operators.stats import global_rank


def token_counts(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, token, cnt. Counting starts from the union of splits, so running it twice changes nothing."""
    return tokens.groupBy(*(keys or []), "token").agg(F.count("*").alias("cnt"))


def ranked(counts: DataFrame, first: str | None = None) -> DataFrame:
    """counts with rank from 1: by count, then first appearance if given, then the token."""
    return global_rank(counts, [F.desc("cnt"), *([F.col(first)] if first else []), F.col("token")])


def top(counts: DataFrame, n: int, drop: tuple[str, ...] = ("<unk>",)) -> DataFrame:
    return counts.where(~F.col("token").isin(*drop)).orderBy(F.desc("cnt"), "token").limit(n)


#: Combined training splits and their parts.
COMBINED = {
    "train-clean": ("train-clean-100", "train-clean-360"),
    "train": ("train-clean-100", "train-clean-360", "train-other-500"),
}


def combine(rows: DataFrame, combined: dict[str, tuple[str, ...]] = COMBINED, split: str = "split") -> DataFrame:
    """Rows of each combined split: the bag union of its parts, in one pass over rows."""
    names = F.create_map(*[x for part in {p for ps in combined.values() for p in ps} for x in (F.lit(part), F.array(*[F.lit(k) for k, ps in combined.items() if part in ps]))])
    return rows.withColumn(split, F.explode(F.coalesce(F.try_element_at(names, F.col(split)), F.array().cast("array<string>"))))


def disjoint_union(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """The union, and the keys that stand in more than one part (none if they are disjoint)."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.drop("_part"), clashes(every, key, "_part")


def clashes(rows: DataFrame, key: str, part: str) -> DataFrame:
    """key, parts: the keys of rows that stand in more than one part."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def known_words(lists: list[DataFrame], vocabulary: DataFrame) -> DataFrame:
    """Words of any list that the vocabulary has."""
    return reduce(DataFrame.unionByName, [x.select("word") for x in lists]).distinct().intersect(vocabulary.select(F.col("token").alias("word")))
