"""What the operators share: tables, scratch tables in the shared folder, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.shared import discard, remove_path, scratch, scratch_path, shared_dir

__all__ = ["discard", "remove_path", "scratch", "scratch_path", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int = 2):
    """True where crc32(doc_id as text) mod modulus is remainder; a null doc_id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: a spanning star forest of the edges seen (union-find by smallest id)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    rows = [(x, r) for x in parent if (r := root(x)) != x]
    yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long.

    Returns (id, component): one row per id that has an edge to another, component being the
    smallest id reachable. Rounds of large-star and small-star over a table of edges, each written
    to the shared folder; before a round every task contracts its own edges to a forest, so the
    table has at most (ids x tasks) rows. Nulls and self loops are dropped; no edges, no rows.
    """
    spark = edges.sparkSession
    schema = "a long, b long"
    now = scratch(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.col("a").cast("long"), F.col("b").cast("long"))
        .mapInPandas(_forest, schema),
        "edges",
    )
    last = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        after = scratch(small.select(F.col("e.u").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        discard(now)
        now = after
        if mark == last or mark[0] == mark[2] and _flat(now):
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = scratch(now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "components")
    discard(now)
    return out


def _flat(edges: DataFrame) -> bool:
    """Whether no id points at an id that points on: with one parent each, the edges are stars."""
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if it has most_rows rows at most, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


class Forest:
    """Union-find over arrays; the root is the smallest index."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            ra, rb = p[a], p[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(p, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while (up := p[p]).tobytes() != p.tobytes():
                p[:] = up
