"""Counts, information, ranks, correlation and moments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probestack.shared import scratch


def contingency(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(keys or []), a, b).agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, mi, h_a, h_b in nats.

    With N rows, cells n and margins n_a, n_b: h_a = ln N - sum(n_a ln n_a) / N and
    mi = ln N + (sum(n ln n) - sum(n_a ln n_a) - sum(n_b ln n_b)) / N. Rows are read once; the cells and both
    margins come from one grouping, and only their sums per key meet.
    """
    keys = keys or []
    cells = contingency(df, a, b, keys)
    every = cells.groupingSets([[*keys, a, b], [*keys, a], [*keys, b]], *keys, a, b).agg(F.sum("n").cast("double").alias("_n"), F.grouping(a).alias("_no_a"), F.grouping(b).alias("_no_b"))
    part = lambda no_a, no_b, x: F.sum(F.when((F.col("_no_a") == no_a) & (F.col("_no_b") == no_b), x))
    self_log = F.col("_n") * F.log("_n")
    sums = (every.groupBy(*keys) if keys else every.groupBy()).agg(part(0, 0, F.col("_n")).alias("_all"), part(0, 0, self_log).alias("_ab"), part(0, 1, self_log).alias("_a"), part(1, 0, self_log).alias("_b"))
    whole = F.log("_all")
    mi, ha, hb = whole + (F.col("_ab") - F.col("_a") - F.col("_b")) / F.col("_all"), whole - F.col("_a") / F.col("_all"), whole - F.col("_b") / F.col("_all")
    return sums.select(*keys, F.col("_all").cast("long").alias("n"), mi.alias("mi"), ha.alias("h_a"), hb.alias("h_b"))


def entropy(df: DataFrame, label: str) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").cast("double").alias("n"))
    return counts.groupBy().agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))


def average_ranks(df: DataFrame, values: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """df with, for each column and name of values, the column's rank from 1 within each key, ties sharing the mean of their ranks.

    Equal values are counted first, then those of all columns are numbered together in whole-table order
    by range, so neither a key nor a tie gathers in one task; the ranks go back to the rows by equi-joins
    that may be split.
    """
    keys, kinds = keys or [], dict(df.dtypes)
    own = lambda c: [F.col(c) if x == c else F.lit(None).cast(kinds[x]).alias(x) for x in values if x not in keys]
    parts = [df.groupBy(*keys, c).agg(F.count("*").alias("_n")).select(F.lit(at).alias("_which"), *keys, *own(c), "_n") for at, c in enumerate(values)]
    rows = dealt(reduce(DataFrame.unionAll, parts), [F.col(c) for c in ("_which", *keys, *values)])
    upto = F.sum("_n").over(Window.partitionBy("_range").orderBy("_within").rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("_upto", upto).join(_carried(rows, F.sum("_n"), F.sum), "_range")
    summed = summed.withColumn("_below", F.coalesce("_before", F.lit(0)) + F.col("_upto") - F.col("_n"))
    least = summed.groupBy("_which", *keys).agg(F.min("_below").alias("_first"))
    summed = _with_key(summed, least, ["_which", *keys])
    out = df
    for at, (c, name) in enumerate(values.items()):
        ranks = summed.where(F.col("_which") == at).select(*keys, c, (F.col("_below") - F.col("_first") + (F.col("_n") + 1) / 2.0).alias(name))
        out = _with_key(out, ranks, [*keys, c])
    return out


def _with_key(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with other's further columns, joined on keys that may be null; without keys other has one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(other))
    same = reduce(lambda a, b: a & b, [F.col(f"_own.{k}").eqNullSafe(F.col(f"_key.{k}")) for k in keys])
    return rows.alias("_own").join(other.alias("_key"), same).select("_own.*", *[F.col(f"_key.{c}") for c in other.columns if c not in keys])


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, rho over the rows that have both values; rho is null where a side does not vary."""
    keys = keys or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(rows, {x: "_x", y: "_y"}, keys)
    return (ranked.groupBy(*keys) if keys else ranked.groupBy()).agg(F.count("*").alias("n"), correlation(F.col("_x"), F.col("_y")).alias("rho"))


def averages(scores: DataFrame, value: str = "rho", weight: str = "n") -> DataFrame:
    """micro: weighted by the number of pairs; macro: plain mean over tasks."""
    return scores.groupBy().agg(F.count("*").alias("n_tasks"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("micro"), F.avg(value).alias("macro"))


def covariance(df: DataFrame, vec: str = "vec", keys: list[str] | None = None) -> DataFrame:
    """keys, i, j, cov (ddof 1) for i <= j, from sums that each task adds up for its own rows."""
    from probestack.operators.cca import fold_moments

    keys = keys or []
    empty = F.array().cast("array<double>")
    sums = fold_moments(df.select(*keys, F.col(vec).alias("v1"), empty.alias("v2"), F.lit(0).alias("fold")), keys)
    width = F.size("s")
    at = lambda i, j: (F.get("m", i * width + j) - F.get("s", i) * F.get("s", j) / F.col("n")) / (F.col("n") - 1)
    cells = F.flatten(
        F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(F.sequence(i, width - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), at(i, j).alias("cov"))))
    )
    return sums.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def dealt(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """df dealt by ranges of order and sorted in them, with _range and _within (from 1), as a written table.

    Range bounds come from a sample that differs from one evaluation to the next, so whatever counts rows
    per range and whatever numbers them must read the same written rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch(placed, "dealt")
    # The id is the partition's number above 33 bits that count its rows.
    return rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_within", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def _carried(rows: DataFrame, total: Column, carry) -> DataFrame:
    """_range and _before: what the ranges before each one come to; one row per range, of which there are as many as partitions."""
    sums = rows.groupBy("_range").agg(total.alias("_total"))
    return F.broadcast(sums.select("_range", carry("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before")))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Row numbers from 1 over the whole table without gathering it in one task.

    Rows are dealt by range, sorted within each range and written; the ranges' sizes give the offsets.
    order must end in a unique key.
    """
    rows = dealt(df, order, partitions)
    numbered = rows.join(_carried(rows, F.count("*"), F.sum), "_range")
    return numbered.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_within")).drop("_range", "_within", "_before")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Row numbers from 1 within each key, however many rows a key has: whole-table numbers less those before the key."""
    every = global_rank(df, [*[F.col(k) for k in keys], *order], "_whole", partitions)
    first = every.groupBy(*keys).agg(F.min("_whole").alias("_first"))
    return _with_key(every, first, keys).withColumn(name, F.col("_whole") - F.col("_first") + 1).drop("_whole", "_first")


def running_min(df: DataFrame, order: list[Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """The smallest value up to each row in order, over the whole table, dealt by range as in global_rank."""
    rows = dealt(df, order, partitions)
    within = F.min(value).over(Window.partitionBy("_range").orderBy("_within").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("_low", within).join(_carried(rows, F.min(value), F.min), "_range")
    return numbered.withColumn(name, F.least("_before", "_low")).drop("_range", "_within", "_low", "_before")


def prefix_sums(df: DataFrame, order: list[Column], columns: dict[str, str], partitions: int | None = None) -> DataFrame:
    """df with, for each column and name of columns, the column's sum over the rows before (0 for the first), dealt by range.

    order must end in a unique key; it is a whole-table sum that never gathers the table in one task.
    """
    rows = dealt(df, order, partitions)
    before = Window.partitionBy("_range").orderBy("_within").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in columns.items()])
    for c, name in columns.items():
        out = out.join(_carried(rows, F.sum(c), F.sum), "_range").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return out.drop("_range", "_within")


def best_by(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of highest score of each key; equal scores go to the first in the order of ties. Null and NaN scores lose."""
    clean = F.when(F.isnan(score), None).otherwise(F.col(score))
    order = Window.partitionBy(*keys).orderBy(clean.desc_nulls_last(), *ties)
    return df.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def nearest_centroid(train: DataFrame, evaluate: DataFrame, keys: list[str], label: str, vec: str, row_id: str) -> DataFrame:
    """evaluate's rows with `assigned`, the label of the nearest centroid (ties: the smallest label).

    Centroids are one row per key and label; they are gathered per key into one array and joined on the
    key, so no row is multiplied by the number of labels in a shuffle.
    """
    from probestack.operators.pooling import vector_means

    return assign_nearest(vector_means(train, [*keys, label], vec), evaluate, keys, label, vec)


def assign_nearest(centroids: DataFrame, evaluate: DataFrame, keys: list[str], label: str, vec: str) -> DataFrame:
    """evaluate's rows with `assigned`, the label of the nearest of centroids (keys, label, vec); ties: the smallest label."""
    from probestack.functions.vectors import squared_distance

    gathered = centroids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), F.col("vec").alias("at")))).alias("centres"))
    joined = evaluate.join(gathered, keys) if keys else evaluate.crossJoin(F.broadcast(gathered))  # one row
    scored = F.transform("centres", lambda s: F.struct(squared_distance(F.col(vec), s["at"]).alias("d"), s["c"].alias("c")))
    return joined.withColumn("assigned", F.array_min(scored)["c"]).drop("centres")
