"""Mixing sources to target weights.

Sizes in words are summed per source; sources in code-point order, null last, weigh 3, 1, 2 in turn
and share 150 % of all words. A target stops at twice its source's size and what is over goes to the
others by weight until none is above (computed at once: with caps c and weights w the level is the
largest (total - caps before) / (weights from here) along c / w, and a target is min(c, level * w)).
rate = target / size of the source; a document is emitted floor(rate) times, and once more where a
number in [0, 1) hashed from seed and doc_id lies below the fraction, so reruns agree. Of SEEDS seeds,
each source uses the one whose taken words come nearest its target (the first of equals).

Only per-source rows leave the map side, pre-aggregated; documents are never shuffled. Sources are
numbered and their caps added up by range, so however many there are, no task holds them all. The
table of sources is broadcast up to BROADCAST_SOURCES rows and joined by key beyond.

Several seeds are tried because one Bernoulli draw cannot meet the contract for small sources of uneven
documents: a source of 50 documents of 1 to 20,000 words is off its target by 20 % and more (README).
The seed that is used is a function of the source alone, and each draw is a hash-seeded Bernoulli draw
with the fraction as its probability.

Defined cases: a null text has size 0; a source without words has target 0 and its documents are not
emitted; a row with a null doc_id draws by its text; rows that repeat a doc_id draw alike; clashing
columns are kept (only a column mix_copy is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import read_table, scratch, small_side
from probestack.operators.stats import global_rank, prefix_sums

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
#: Draws that are tried per source; the one whose sum comes nearest its target is used.
SEEDS = 16
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source of sized (source, size): source, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_rank(per, [F.col("source").asc_nulls_last()], "at").withColumn("at", F.col("at") - 1)
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weigh).withColumn("cap", most * F.col("source_size"))
    along = [F.col("cap") / F.col("weight"), F.col("at")]
    levels = prefix_sums(per, along, {"cap": "before", "weight": "lighter"})
    whole = levels.groupBy().agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights"))  # one row
    level = (share * F.col("all") - F.col("before")) / (F.col("weights") - F.col("lighter"))
    top = levels.crossJoin(F.broadcast(whole)).groupBy().agg(F.max(level).alias("level"))  # one row
    filled = levels.crossJoin(F.broadcast(top))
    return filled.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a document's draw is hashed from: its doc_id, or the digest of its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def uniform(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an md5."""
    digest = F.md5(F.concat(seed, F.lit("/"), key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _copies(key: Column, seed: Column) -> Column:
    """Copies of a document of a source with column rate."""
    return (F.floor("rate") + (uniform(key, seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")


def _small(table: DataFrame) -> DataFrame:
    return small_side(table, BROADCAST_SOURCES)


def source_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, target, rate and seed of each source of sized (draw, source, size)."""
    targets = source_targets(sized.select("source", "size"), weights, share, most)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    targets = scratch(targets.withColumn("rate", rate), "targets")
    drawn = sized.join(_small(targets.withColumnRenamed("source", "key")), F.col("key").eqNullSafe(F.col("source")))
    taken = [F.sum(F.col("size") * _copies(F.col("draw"), F.lit(f"{seed}.{k}"))).alias(f"taken_{k}") for k in range(seeds)]
    sums = drawn.groupBy("key").agg(*taken)
    both = targets.join(sums, F.col("source").eqNullSafe(F.col("key")))
    off = F.array_min(F.array(*[F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(seeds)]))
    return scratch(both.select("source", "source_size", "target", "rate", F.concat(F.lit(f"{seed}."), off["k"].cast("string")).alias("seed")), "sources")


def _sized(docs: DataFrame) -> DataFrame:
    return scratch(docs.select("doc_id", "source", draw_key(F.col("doc_id"), F.col("text")).alias("draw"), word_count(F.col("text")).alias("size")), "sized")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (its source's), copies, taken (size x copies)."""
    sized = _sized(docs)
    sources = _small(source_plan(sized, **options).withColumnRenamed("source", "key"))
    planned = sized.join(sources, F.col("key").eqNullSafe(F.col("source"))).withColumn("copies", _copies(F.col("draw"), F.col("seed")))
    return planned.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: docs' columns, each row as often as its copies, numbered from 1 in mix_copy."""
    sources = _small(source_plan(_sized(docs), **options).select(F.col("source").alias("key"), "rate", "seed"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    planned = rows.join(sources, F.col("key").eqNullSafe(F.col("row.source"))).select("row", _copies(draw_key(F.col("row.doc_id"), F.col("row.text")), F.col("seed")).alias("copies")).where("copies > 0")
    names = [c for c in docs.columns if c != "mix_copy"]
    numbered = planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy"))
    return numbered.select(*[F.col(f"row.`{c}`") for c in names], "mix_copy")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the mixture of what is left."""
    return mix(docs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS draw, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
capped AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, 2e0 * source_size AS cap FROM per),
levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM capped),
targets AS (
  SELECT source, source_size, least(cap, weight * max(here) OVER ()) AS target FROM levels),
rates AS (
  SELECT doc_id, draw, size, source, targets.source_size, target, CASE WHEN source_size = 0 THEN 0e0 ELSE target / source_size END AS rate
  FROM (SELECT doc_id, draw, source AS key, size FROM sized) JOIN targets ON key IS NOT DISTINCT FROM source),
draws AS (
  SELECT source, target, k, sum(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST('0x' || substr(md5('mix.' || k || '/' || draw), 1, 12) AS BIGINT) / 281474976710656e0 < rate - floor(rate) THEN 1 ELSE 0 END)) AS taken
  FROM rates, range(16) t(k) GROUP BY ALL),
seeds AS (SELECT source AS key, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(taken - target), k) AS first FROM draws) WHERE first = 1),
copied AS (
  SELECT rates.*, CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST('0x' || substr(md5('mix.' || k || '/' || draw), 1, 12) AS BIGINT) / 281474976710656e0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM rates JOIN seeds ON source IS NOT DISTINCT FROM key)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM copied
"""
