"""Embedding near-duplicates by a subspace pigeonhole join, exact at cosine >= THRESHOLD.

Unit vectors with cosine >= t lie within squared distance 2 (1 - t). They are rotated (principal axes
of a bounded sample, which bears on speed alone) and their coordinates dealt in turn to blocks of
BLOCK_DIMS. Each block gets a share of the squared-distance budget in proportion to its dimensions;
if a pair is within the whole budget, it is within its share in one block at least. Per block, a range
join: slabs of the block's leading coordinate, one budget radius wide, are compared with themselves
and the next slab. A pair within a block's share is verified by its exact cosine in double precision,
in the first block that admits it only, so the union over blocks counts no pair twice.

Slabs are cut by hash into chunks of CHUNK vectors at most and compared chunk by chunk, so a task holds
two chunks whatever a slab, label or group of copies may hold. Tasks give link counts per vector and a
spanning forest of their links, never the pairs. Equal vectors meet as one representative that counts
as often as it occurs.

Defined cases: rows with a null label or vec_id, a null vector, a null or non-finite component or zero
norm link with nothing (n_links 0, component_id vec_id, kept true); vectors of different lengths do not
link; rows that repeat vec_id, label and vector come out once; a vec_id with several vectors comes out
once for each, links counted by vector; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import Forest, components, discard, read_table, scratch, small_side

THRESHOLD = 0.93
BLOCK_DIMS = 16
CHUNK = 4096
SAMPLE = 4096
#: Pairs whose block distances, and then whose cosines, a task computes at once.
TILE_PAIRS = 1 << 20
COSINES = 1 << 16
BROADCAST_CELLS = 100_000
#: Relative to unit vectors: room for rounding in the budget tests, which only choose candidates.
SLACK = 1e-9


def rotation(dims: int, sample: np.ndarray | None) -> np.ndarray:
    """An orthogonal matrix: principal axes of the sample by falling variance, or seeded where it is too small."""
    if sample is not None and len(sample) >= 2 * dims:
        return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def blocks_of(dims: int) -> list[np.ndarray]:
    n = max(1, -(-dims // BLOCK_DIMS))
    return [np.arange(b, dims, n) for b in range(n)]


class Geometry:
    """Rotations by length of vector, and the blocks with their budgets."""

    def __init__(self, threshold: float, samples: dict[int, np.ndarray]):
        self.threshold, self.samples, self.made = threshold, {d: rotation(d, s) for d, s in samples.items()}, {}

    def of(self, dims: int) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
        if dims not in self.made:
            turn = self.samples.get(dims)
            blocks = blocks_of(dims)
            whole = 2 * (1 - self.threshold) + SLACK
            self.made[dims] = rotation(dims, None) if turn is None else turn, blocks, [whole * len(b) / dims for b in blocks]
        return self.made[dims]


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length as float64, each scaled by a power of two (exactly) to components of at most 1."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    if not len(column):
        return np.zeros((0, dims))
    rows = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), dims) for c in chunks])
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _slabs(geometry: Geometry):
    """(id, label, dims, block, slab) of each vector in each block."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                turn, blocks, budgets = geometry.of(int(dims))
                v = matrix(part.column("vec"), int(dims))
                v = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn
                for b, (axes, budget) in enumerate(zip(blocks, budgets, strict=True)):
                    slab = np.floor(v[:, axes[0]] / (budget**0.5 * (1 + 1e-9))).astype(np.int32)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("label"), part.column("dims"), pa.array(np.full(n, b, np.int32)), pa.array(slab), part.column("times"), part.column("vec")],
                        names=["id", "label", "dims", "block", "slab", "times", "vec"],
                    )

    return run


def linked(x: np.ndarray, y: np.ndarray, block: int, same: bool, geometry: Geometry, tile_pairs: int = TILE_PAIRS, cosines: int = COSINES):
    """Index pairs of x and y, tile by tile, that link and whose first admitting block is block."""
    dims = x.shape[1]
    turn, blocks, budgets = geometry.of(dims)
    ux, uy = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    zx, zy = ux @ turn, uy @ turn
    axes, budget = blocks[block], budgets[block]
    bx, by = zx[:, axes], zy[:, axes]
    ny = np.einsum("ij,ij->i", by, by)
    tile = max(1, tile_pairs // max(len(y), 1))
    for at in range(0, len(x), tile):
        t = bx[at : at + tile]
        near = np.einsum("ij,ij->i", t, t)[:, None] + ny[None, :] - 2 * (t @ by.T) <= budget + 1e-7
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(block + 1):
            if not len(i):
                break
            # Coordinate by coordinate, so that every task rounds a pair alike.
            gap = np.zeros(len(i))
            for axis in blocks[k]:
                gap += (zx[i, axis] - zy[j, axis]) ** 2
            inside = gap <= budgets[k]
            keep = inside if k == block else ~inside
            i, j = i[keep], j[keep]
        for part in range(0, len(i), cosines):
            a, b = i[part : part + cosines], j[part : part + cosines]
            u, v = x[a], y[b]
            cosine = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
            hit = cosine >= geometry.threshold
            if hit.any():
                yield a[hit], b[hit]


def _compare(geometry: Geometry):
    def run(table: pa.Table) -> pa.Table:
        dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        n = int((side == 0).sum())
        ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
        v = matrix(table.column("vec"), dims)
        x, y, shift = (v, v, 0) if same else (v[:n], v[n:], n)
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        if len(x) and len(y):
            for i, j in linked(x, y, block, same, geometry):
                j = j + shift
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                forest.join(i, j)
        # Lower indices need not have lower ids: an edge to the root is all that is wanted.
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(ids[forest.parent[some]])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding, label)."""
    # Single precision travels as it is stored, at half the bytes; all arithmetic is in double.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall("vec", lambda x: x == 0)
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & ~zero, F.lit(False))
    rows = scratch(rows.withColumn("fit", fit).distinct(), "vectors")
    valid = rows.where("fit").select("vec_id", "label", "vec")
    reps = scratch(valid.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")).withColumn("dims", F.size("vec")), "representatives")

    sample = reps.orderBy(F.xxhash64("id")).select("dims", "vec").limit(SAMPLE).toPandas()
    geometry = Geometry(threshold, {int(d): _unit(np.stack(g["vec"].to_list())) for d, g in sample.groupby("dims")} if len(sample) else {})

    slabs = scratch(reps.mapInArrow(_slabs(geometry), f"id long, label string, dims int, block int, slab int, times long, vec {kind}"), "slabs")
    key = ["label", "dims", "block"]
    cells = scratch(slabs.groupBy(*key, "slab").agg(F.count("*").alias("n")).select(*key, "slab", F.ceil(F.col("n") / chunk).cast("int").alias("k")), "cells")
    # A chunk meets the chunks from its own on in its slab, and all of the next slab.
    later = cells.select(*key, (F.col("slab") - 1).alias("slab"), F.col("k").alias("next_k"))
    pairs = cells.join(later, [*key, "slab"], "left").select(*key, F.col("slab").alias("a"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "k", F.coalesce("next_k", F.lit(0)).alias("next_k"))
    own = F.transform(F.sequence(F.col("i"), F.col("k") - 1), lambda j: F.struct(F.col("a").alias("b"), j.alias("j")))
    onward = F.when(F.col("next_k") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("next_k"), F.lit(1)) - 1), lambda j: F.struct((F.col("a") + 1).alias("b"), j.alias("j"))))
    tasks = pairs.select(*key, "a", "i", F.explode(F.concat(own, F.coalesce(onward, F.array().cast("array<struct<b:int,j:int>>")))).alias("t")).select(*key, "a", "i", "t.b", "t.j")
    roles = tasks.select(*key, "a", "i", "b", "j", F.explode(F.when((F.col("a") == F.col("b")) & (F.col("i") == F.col("j")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    roles = roles.withColumn("slab", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))).withColumn("part", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    dealt_to = scratch(roles, "roles")
    roles = small_side(dealt_to, BROADCAST_CELLS)
    placed = slabs.join(small_side(cells, BROADCAST_CELLS), [*key, "slab"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = placed.join(roles, [*key, "slab", "part"]).select(*key, "a", "i", "b", "j", "side", "id", "times", "vec")
    found = scratch(dealt.groupBy(*key, "a", "i", "b", "j").applyInArrow(_compare(geometry), "id long, links long, root long"), "links")
    discard(slabs, cells, dealt_to)

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    done = reps.select("label", "vec", F.col("id").alias("rep"), "times").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    done = done.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_rows = valid.join(done, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked_rows.unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT c.x AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON c.x = n.x
"""
