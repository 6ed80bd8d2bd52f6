"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts are lower-cased and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A mask such as 11011001
names the places of an 8-word window that count; a hash of those words (and the mask's number) is
joined between documents and benchmark items, so a substituted word at an ignored place does not
break a hit. Every hit names a diagonal (document position minus item position). Along each, the
item is compared with the document word for word. A document is contaminated by an item if at least
MIN_OVERLAP of the item's words match on the diagonals together, or DENSE words within a stretch of
STRETCH on one of them, so parts of long items count as well.

Those masks miss substitutions in short items. Items of fewer than LIGHT_BELOW words are looked up by
LIGHT_MASKS too, all masks of three words within five: where three fifths of the words match on one
diagonal, some five in a row have three that match, so every such placement is hit. These masks
meet much by chance, so a diagonal they hit counts only if it has MIN_OVERLAP of the item by itself and
the document has a word for each of the item's.

Items of fewer than MIN_WORDS words are matched as a whole, by a mask of their length: with so few words
a substitution leaves nothing to tell an overlap from chance. The operator reports them; the pipeline
drops documents for items of MIN_WORDS words or more, as a word or two are no evidence of a leak.

Windows are made and hashed inside one generated loop over a document's word array and looked up in
the benchmark's hashes there; only hits leave it. The benchmark side is broadcast up to
BROADCAST_SEEDS rows. A larger one is cut by hash into parts of that size, each broadcast in a pass of
its own over the documents, and only hits meet its rows by a shuffle; windows are never shuffled.

Defined cases: items of five to seven words are matched by runs of five words and the light masks;
null items and items without a word never match; rows that repeat an item_id with another text are items of
their own under one id, reported by the best; null or empty documents never match; a null doc_id is
reported as null; repeated documents are reported once per doc_id and item; clashing columns are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probestack.llm.shared import read_table, scratch, small_side

#: Two masks of weight 5 over 8 words, for items of 8 words and more; runs of five for shorter ones.
MASKS = ("11011001", "10010111")
SHORT_MASK = "11111"
#: All masks of weight 3 over five words at most.
LIGHT_MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
LIGHT_BELOW = 25
MIN_WORDS = 5
#: Numbers set the hashes of one mask apart from those of another.
LONG = list(enumerate(MASKS))
SHORT = [(len(LONG), SHORT_MASK)]
LIGHT = list(enumerate(LIGHT_MASKS, len(LONG) + 1))
TINY = list(enumerate(("1" * k for k in range(1, MIN_WORDS)), len(LONG) + 1 + len(LIGHT)))
MIN_OVERLAP = 0.6
DENSE, STRETCH = 13, 16
BROADCAST_SEEDS = 1_000_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _seed(words: Column, at: Column, mask: str, number: int) -> Column:
    """Hash of the masked words of the window that starts at 0-based place at."""
    return F.xxhash64(F.lit(number), *[F.get(words, at + F.lit(i)) for i, bit in enumerate(mask) if bit == "1"])


def _windows(rows: DataFrame, keep: list[str], masks: list[tuple[int, str]]) -> DataFrame:
    """keep, at, seed for each window of `words` under each of the masks; one that passes the end of the words has no seed."""
    span = min(len(m) for _, m in masks)
    long = rows.where(F.size("words") >= span)
    inside = lambda m: F.col("at") <= F.size("words") - len(m)
    seeds = [_seed(F.col("words"), F.col("at"), m, n) if len(m) == span else F.when(inside(m), _seed(F.col("words"), F.col("at"), m, n)) for n, m in masks]
    placed = long.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("at"))
    return placed.select(*keep, "words", "at", F.explode(F.array(*seeds)).alias("seed"))


def _hits(bodies: DataFrame, seeds: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """doc_id, item_id, item_key, n_item_words, start and the document's words that lie along the item, per hit."""
    windows, n = _windows(bodies, ["doc_id"], masks), seeds.count()
    start = F.col("at") - F.col("item_at")
    if n <= BROADCAST_SEEDS:
        found = windows.join(F.broadcast(seeds), "seed").withColumn("base", F.lit(0)).withColumnRenamed("words", "around")
    else:
        longest = seeds.agg(F.max("n_item_words")).first()[0]
        passes = -(-n // BROADCAST_SEEDS)
        parts = [windows.join(F.broadcast(seeds.where(F.pmod("seed", F.lit(passes)) == k).select("seed").distinct()), "seed", "left_semi") for k in range(passes)]
        base = F.greatest(F.col("at") - longest, F.lit(0))
        near = reduce(DataFrame.unionAll, parts).select("doc_id", "at", "seed", base.alias("base"), F.slice("words", base + 1, 2 * longest).alias("around"))
        found = near.join(seeds, "seed")
    part = F.slice("around", F.greatest(start, F.lit(0)) - F.col("base") + 1, F.col("n_item_words") + F.least(start, F.lit(0)))
    return found.select("doc_id", "item_id", "item_key", "n_item_words", start.alias("start"), part.alias("part"))


def _places(lines: DataFrame) -> Column:
    """The item's places that match along `start`. Place i lies at index i, or i + start where start < 0, of part."""
    lead = F.least(F.col("start"), F.lit(0))
    return F.filter(F.sequence(F.lit(0), F.col("n_item_words") - 1), lambda i: (i + lead >= 0) & F.coalesce(F.get("item", i) == F.get("part", i + lead), F.lit(False)))


def _seeds(items: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """item_id, item_key, n_item_words, item_at, seed of items under each of the masks, as a written table."""
    keep = ["item_id", "item_key", "n_item_words"]
    windows = _windows(items.withColumn("n_item_words", F.size("words")), keep, masks)
    return scratch(windows.select(*keep, F.col("at").alias("item_at"), "seed").where("seed is not null").distinct(), "seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, dense: int = DENSE, stretch: int = STRETCH, least_words: int = 1) -> DataFrame:
    """doc_id, item_id, n_matched, n_dense, n_item_words, overlap of documents that hold an item of least_words or a dense part of it."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= max(least_words, 1)).distinct()
    items = scratch(items.select("item_id", "words", F.xxhash64("words").alias("item_key")), "items")
    n = F.size("words")
    whole = items.select(F.col("item_key").alias("own_key"), F.col("item_id").alias("own_id"), F.col("words").alias("item"))
    whole = small_side(whole, BROADCAST_SEEDS // 20)
    of_item = lambda rows: rows.join(whole, (F.col("item_key") == F.col("own_key")) & F.col("item_id").eqNullSafe(F.col("own_id"))).drop("own_key", "own_id")
    bodies = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    key = ["doc_id", "item_id", "item_key", "n_item_words"]
    lines, found = [], []
    for masks, group in ((LONG, items.where(n >= len(MASKS[0]))), (SHORT, items.where((n >= MIN_WORDS) & (n < len(MASKS[0])))), (LIGHT, items.where((n >= MIN_WORDS) & (n < LIGHT_BELOW)))):
        seeds = _seeds(group, masks)
        if not seeds.isEmpty():
            hits = _hits(bodies, seeds, masks)
            if masks is LIGHT:
                hits = of_item(hits)
                hits = hits.where((F.size("part") == F.col("n_item_words")) & (F.size(_places(hits)) >= min_overlap * F.col("n_item_words"))).drop("item")
            lines.append(hits)
    for number, mask in TINY:
        seeds = _seeds(items.where(n == len(mask)), [(number, mask)])
        if not seeds.isEmpty():
            hits = of_item(_hits(bodies, seeds, [(number, mask)])).where(F.col("part") == F.col("item")).select(key).distinct()
            found.append(hits.select(*key, F.col("n_item_words").alias("n_matched"), F.col("n_item_words").alias("n_dense")))
    if lines:
        each = of_item(reduce(DataFrame.unionAll, lines).groupBy(*key, "start", "part").agg(F.lit(1).alias("one")))
        matched = each.select(*key, "start", F.explode(_places(each)).alias("place"))
        ahead = Window.partitionBy("doc_id", "item_id", "item_key", "start").orderBy("place").rangeBetween(0, stretch - 1)
        matched = matched.withColumn("near", F.count("*").over(ahead))
        per = matched.groupBy(*key).agg(F.count_distinct("place").alias("n_matched"), F.max("near").alias("n_dense"))
        found.append(per.where((F.col("n_matched") >= min_overlap * F.col("n_item_words")) | (F.col("n_dense") >= dense)).select(*key, "n_matched", "n_dense"))
    if not found:
        rows = docs.select("doc_id").limit(0).crossJoin(benchmark.select("item_id").limit(0))  # no rows on either side
        return rows.select("doc_id", "item_id", *[F.lit(0).cast("long").alias(c) for c in ("n_matched", "n_dense", "n_item_words")], F.lit(0.0).alias("overlap"))
    best = F.max(F.struct((F.col("n_matched") / F.col("n_item_words")).alias("overlap"), "n_dense", "n_matched", "n_item_words"))
    out = reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("n_matched", "n_dense", "n_item_words")], F.col("best.overlap").alias("overlap"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose text holds a benchmark item of MIN_WORDS words or more go, with or without a doc_id."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    found = contaminated(texts, read_table(spark, sf_dir, "benchmark"), least_words=MIN_WORDS)
    found = scratch(found.select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("own"))
    left = rows.join(found, F.col("own") == F.col("leaked"), "left_anti")
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _sql_seeds(source: str, keep: str, masks: list[tuple[int, str]], where: str) -> str:
    arms = []
    for number, mask in masks:
        parts = ", ".join(f"words[p + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
        arms.append(f"SELECT {keep}, p AS place, [{parts}] AS seed, {number} AS mask FROM (SELECT {keep}, words, unnest(range(0, len(words) - {len(mask)} + 1)) AS p FROM {source} WHERE len(words) >= {len(mask)} AND {where})")
    return " UNION ALL ".join(arms)


_WORDS = "regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT DISTINCT item_id, {_WORDS} AS words FROM benchmark),
item_seeds AS ({_sql_seeds('i', 'item_id, words', LONG, f'len(words) >= {len(MASKS[0])}')} UNION ALL {_sql_seeds('i', 'item_id, words', SHORT, f'len(words) < {len(MASKS[0])}')}),
doc_seeds AS ({_sql_seeds('d', 'doc_id', LONG + SHORT, 'true')}),
light_items AS ({_sql_seeds('i', 'item_id, words', LIGHT, f'len(words) >= {MIN_WORDS} AND len(words) < {LIGHT_BELOW}')}),
light_docs AS ({_sql_seeds('d', 'doc_id', LIGHT, 'true')}),
light_lines AS (
  SELECT DISTINCT doc_id, item_id, light_items.words AS item, light_docs.place - light_items.place AS start
  FROM light_docs JOIN light_items ON light_docs.mask = light_items.mask AND light_docs.seed = light_items.seed),
lines AS (
  SELECT DISTINCT doc_id, item_id, item_seeds.words AS item, doc_seeds.place - item_seeds.place AS start
  FROM doc_seeds JOIN item_seeds ON doc_seeds.mask = item_seeds.mask AND doc_seeds.seed = item_seeds.seed
  UNION
  SELECT doc_id, item_id, item, start FROM light_lines JOIN d USING (doc_id)
  WHERE start >= 0 AND start + len(item) <= len(d.words) AND len(list_filter(range(len(item)), lambda k: d.words[start + k + 1] = item[k + 1])) >= {MIN_OVERLAP} * len(item)),
cells AS (SELECT doc_id, item_id, item, start, unnest(range(0, len(item))) AS k FROM lines),
same AS (
  SELECT cells.doc_id, item_id, item, start, k, count(*) OVER (PARTITION BY cells.doc_id, item_id, item, start ORDER BY k RANGE BETWEEN CURRENT ROW AND {STRETCH - 1} FOLLOWING) AS near
  FROM cells JOIN d USING (doc_id) WHERE start + k >= 0 AND start + k < len(d.words) AND d.words[start + k + 1] = item[k + 1]),
matched AS (SELECT doc_id, item_id, item, count(DISTINCT k) AS n_matched, max(near) AS n_dense FROM same GROUP BY doc_id, item_id, item),
tiny AS (SELECT DISTINCT doc_id, i.item_id, i.words AS item FROM d JOIN i ON len(i.words) BETWEEN 1 AND {MIN_WORDS - 1} AND contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string(i.words, ' ') || ' '))
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_dense AS BIGINT) AS n_dense, CAST(len(item) AS BIGINT) AS n_item_words, n_matched / len(item) AS overlap
FROM matched WHERE len(item) >= {MIN_WORDS} AND (n_matched >= {MIN_OVERLAP} * len(item) OR n_dense >= {DENSE})
UNION ALL SELECT doc_id, item_id, len(item), len(item), len(item), 1e0 FROM tiny
"""
