"""Near-duplicate documents by BagMinHash over multisets of word 5-shingles.

A text's bag holds its runs of five words (fewer words: one run of all; A-Z lowered, words
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`), each with its count. Weights are discretised at the whole
numbers. Every shingle owns, for each dyadic interval [0,1), [1,2), [2,4), ... of weight, a Poisson
process of points (time, place in the interval, register); a register keeps the earliest time among
points whose place lies below the shingle's count. An interval wholly below the count takes all
points; the top one is resolved point by point. Two bags agree in a register with a probability
equal to their weighted Jaccard similarity, and points are drawn in order of time until none can
change a register. Bands of registers name candidates; each candidate is verified by exact multiset
overlap; classes are the connected components of verified links.

No bucket is expanded into pairs. A first pass verifies every member of a bucket against one member
drawn by hash. Where a bucket then still holds several components, members outside its largest one
meet all members of other components: chunk by chunk, bags held once per chunk, in tasks that return a
spanning forest of the links they find. Copies of one text cost one comparison per band, and no link
between different components is passed over.

A bag belongs to a text, not to a doc_id: texts are told apart by a 128-bit digest of their words. In each
class one row is kept, that with the smallest (doc_id, null last; then digest); class_id is its doc_id.

Defined cases: a null, empty or wordless text is a class of its own; texts with the same words are
exact copies and share a class; rows with a null doc_id are classed as any other, and class_id is null
where no member has a doc_id; rows that repeat a doc_id and its words come out once; a doc_id with
several texts comes out once per text. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import Forest, components, discard, read_table, scratch
from probestack.llm.text import ALNUM, U, Words, bounded, gram_hashes, mix, split_words, streams

WIDTH = 5
THRESHOLD = 0.8
#: 24 bands of 5 registers: at similarity 0.8 a pair misses every band with probability 7e-5.
BANDS, ROWS = 24, 5


def bag(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, count) of the distinct keys of each doc; keys come salted by doc, so equal means same doc."""
    salted = mix(keys ^ mix(doc.astype(U) + U(0x1234567)))
    order = np.sort(salted)
    repeated = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(repeated):
        return keys, doc, np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(repeated, salted), len(repeated) - 1)
    again = repeated[at] == salted
    _, index, counts = np.unique(salted[again], return_index=True, return_counts=True)
    single, where = ~again, np.flatnonzero(again)[index]
    return (
        np.concatenate([keys[single], keys[where]]),
        np.concatenate([doc[single], doc[where]]),
        np.concatenate([np.ones(single.sum(), np.int64), counts]),
    )


def signatures(keys: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """BagMinHash: n_docs x registers earliest times; infinite for an empty bag."""
    out = np.full(n_docs * registers, np.inf)
    process, length, limit, owner = [mix(keys ^ U(0xA5A5))], [np.ones(len(keys))], [np.ones(len(keys))], [doc]
    level = 0
    heavy = weight > 1
    k, w, d = keys[heavy], weight[heavy], doc[heavy]
    while len(k):  # [2^level, 2^(level+1)), as far as the weight goes
        low = 1 << level
        process.append(mix(k ^ U(0xA5A5 + level + 1)))
        length.append(np.full(len(k), float(low)))
        limit.append(np.minimum((w - low) / low, 1.0))
        owner.append(d)
        level += 1
        more = w > (1 << level)
        k, w, d = k[more], w[more], d[more]
    process, length, limit, owner = (np.concatenate(x) for x in (process, length, limit, owner))
    time, step = np.zeros(len(process)), 0
    while len(process):
        step += 1
        draw = mix(process + U(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        draw = mix(draw ^ U(0x6C62272E07BB0142))
        place = (draw >> U(32)).astype(np.float64) * 2.0**-32
        hit = place < limit
        slot = owner * registers + ((draw & U(0xFFFFFFFF)) % U(registers)).astype(np.int64)
        if hit.all():
            np.minimum.at(out, slot, time)
        else:
            np.minimum.at(out, slot[hit], time[hit])
        last = out.reshape(n_docs, registers).max(axis=1)
        live = time < last[owner]
        process, length, limit, owner, time = (x[live] for x in (process, length, limit, owner, time))
    return out.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_docs x bands 64-bit hashes; a band's number is part of the hash."""
    bits = signature.view(U).reshape(len(signature), bands, rows)
    total = np.tile(streams(7, bands), (len(signature), 1))
    for j, c in enumerate(streams(8, rows)):
        total = mix(total ^ (bits[:, :, j] * c))
    return total


def digests(words: Words) -> list[np.ndarray]:
    """Two 64-bit digests of each text's words in order: together they name exact copies."""
    place = np.arange(len(words.hash), dtype=U) - np.repeat(words.first[:-1], words.counts).astype(U)
    out = []
    for salt in (U(0x51ED), U(0xC0FFEE)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(words.hash + mix(place + salt)), dtype=U)])
        out.append((total[words.first[1:]] - total[words.first[:-1]]).view(np.int64))
    return out


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            words = split_words(batch.column("text"), ALNUM)
            grams, doc = gram_hashes(words, width)
            keys, owner, weight = bag(grams, doc, words.n_docs)
            sig = band_hashes(signatures(keys, owner, weight, words.n_docs, bands * rows), bands, rows)
            flat = pa.array(sig.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(words.counts.astype(np.int64)), *map(pa.array, digests(words)), lists],
                names=["doc_id", "k1", "k2", "n_words", "d1", "d2", "bands"],
            )

    return run


def _elements(width: int):
    """Bags as sorted arrays of 64-bit elements: (shingle, 0), (shingle, 1), ... up to its count.

    Of the rows (id, d1, d2, text) those are taken whose words have that digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            words = split_words(batch.column("text"), ALNUM)
            own = np.ones(batch.num_rows, bool)
            for name, digest in zip(("d1", "d2"), digests(words), strict=True):
                own &= batch.column(name).to_numpy() == digest
            grams, doc = gram_hashes(words, width)
            keys, owner, weight = bag(grams, doc, words.n_docs)
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            owner = np.repeat(owner, weight)
            flat = mix(np.repeat(keys, weight) + mix(nth.astype(U)))
            order = np.argsort(owner, kind="stable")
            offsets = np.searchsorted(owner[order], np.arange(words.n_docs + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "bag"]).filter(pa.array(own))

    return run


def _bags(ids: DataFrame, texts: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Bags (id, bag) of the texts in ids (id), one each, by way of the doc_id that texts has for each.

    Merge joins at every size: what would be broadcast here grows with the input.
    """
    wanted = texts.select("id", "d1", "d2", F.col("rep").alias("own"), "again").join(ids.distinct().hint("merge"), "id", "left_semi")
    found = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "d1", "d2", "again", "text")
    schema = "id long, bag array<long>"
    cut = lambda rows: rows.select("id", "d1", "d2", "text").mapInArrow(_elements(width), schema)
    bags = cut(found.where("not again"))
    if not texts.where("again").isEmpty():  # rows that repeat a doc_id and its words, or have no doc_id: one of each
        bags = bags.unionAll(cut(found.where("again").dropDuplicates(["id", "text"])).dropDuplicates(["id"]))
    return scratch(bags, "bags")


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose bags overlap by threshold or more."""
    joined = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")).hint("merge"), "a")
    joined = joined.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y")
    near = joined.where(F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y"))).where(common >= threshold * (whole - common))
    return scratch(near.select("a", "b").distinct(), "links")


#: Members of a bucket, and words of theirs, that a task holds of either side; elements whose occurrences it multiplies at once.
CHUNK = 1024
CHUNK_WORDS = 1 << 20
COLUMNS = 4096


def overlaps(elements: np.ndarray, row: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the bags of rows left with those of rows right; elements lie in row's bags."""
    order = np.argsort(elements, kind="stable")
    elements, row = elements[order], row[order]
    starts = np.concatenate([[True], elements[1:] != elements[:-1]]) if len(elements) else np.zeros(0, bool)
    column = np.cumsum(starts) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else starts
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = slice(np.searchsorted(column, at), np.searchsorted(column, at + COLUMNS))
        r, c = row[here], column[here] - at
        sides = []
        for k, size in ((0, len(left)), (1, len(right))):
            m = np.zeros((size, COLUMNS), np.float32)
            mine = place[k, r] >= 0
            m[place[k, r[mine]], c[mine]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _meet(threshold: float):
    """Links between different components among the members of a task, as a forest (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        kind, same = table.column("kind")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        part = table.column("part").to_numpy()
        if kind == 1:  # members outside the largest component against those inside
            left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
        elif same:
            left = right = np.arange(len(ids))
        else:
            left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        lists = table.column("bag").combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        common = overlaps(lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes), len(ids), left, right)
        whole = sizes[left][:, None] + sizes[right][None, :]
        x, y = np.nonzero((common >= threshold * (whole - common)) & (component[left][:, None] != component[right][None, :]))
        x, y = left[x], right[y]
        forest = Forest(len(ids))
        forest.join(x, y)
        joined = np.flatnonzero(forest.parent != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[joined]), "b": pa.array(ids[forest.parent[joined]])})

    return run


def _met(mine: DataFrame, texts: DataFrame, docs: DataFrame, width: int, threshold: float, chunk: int) -> DataFrame | None:
    """Links between components that share a bucket, for mine (bucket, id, component, n_words); None if no bucket has two."""
    parts = mine.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    most = F.max(F.struct("n", "component", "w"))
    mixed = parts.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    cut = lambda n, w: F.greatest(F.ceil(n / chunk), F.ceil(w / CHUNK_WORDS)).cast("int")
    inside, outside = cut(F.col("most.n"), F.col("most.w")), cut(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"))
    mixed = mixed.select("bucket", F.col("most.component").alias("major"), inside.alias("k_in"), outside.alias("k_out"))
    rows = mine.join(mixed.hint("merge"), "bucket").withColumn("outer", F.col("component") != F.col("major"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("outer"), F.col("k_out")).otherwise(F.col("k_in"))).cast("int"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(upto("k_out"), lambda j: task(0, F.least(F.col("part"), j), F.greatest(F.col("part"), j)))
    across = F.transform(upto("k_in"), lambda j: task(1, F.col("part"), j))
    inside = F.transform(upto("k_out"), lambda i: task(1, i, F.col("part")))
    rows = scratch(rows.select("bucket", "id", "component", "outer", "part", F.explode(F.when(F.col("outer"), F.concat(among, across)).otherwise(inside)).alias("t")).select("*", "t.*").drop("t"), "mixed")
    if rows.isEmpty():
        return None
    bags = _bags(rows.select("id"), texts, docs, width)
    dealt = rows.join(bags.hint("merge"), "id")
    links = scratch(dealt.groupBy("bucket", "kind", "i", "j").applyInArrow(_meet(threshold), "a long, b long").distinct(), "links")
    discard(bags)
    discard(rows)
    return links


def classed(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, k1, k2, n, class_id, kept, n_words: a row per doc_id and words.

    k1 and k2 are a 128-bit hash of the raw text that stands for them (the smallest, where several raw
    texts of a doc_id have the same words), n the number of rows. Wordless rows come once per raw text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    signed = scratch(keyed.mapInArrow(_sign(width, bands, rows), "doc_id long, k1 long, k2 long, n_words long, d1 long, d2 long, bands array<long>"), "signed")
    worded = signed.where("n_words > 0")
    # Of a text's rows the one with the smallest doc_id brings its words; again: that doc_id may bring them more than once.
    own = worded.groupBy("d1", "d2", "doc_id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words"))
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "n", "bands", "n_words")).alias("m")
    texts = own.groupBy("d1", "d2").agg(least).select("d1", "d2", F.col("m.doc_id").alias("rep"), ((F.col("m.n") > 1) | F.col("m.none")).alias("again"), "m.bands", "m.n_words")
    texts = scratch(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    buckets = texts.select("id", "n_words", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bucket", "id").alias("by"), "id"))["id"].alias("centre")).where("n > 1")
    held = scratch(buckets.join(full.hint("merge"), "bucket").select("bucket", "id", "centre", "n_words"), "buckets")
    star = scratch(held.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "star")
    bags = _bags(star.select(F.explode(F.array("a", "b")).alias("id")), texts, docs, width)
    links = _verified(star, bags, threshold)
    discard(bags, star)
    classes = components(links)
    mine = held.join(classes.hint("merge"), "id", "left").select("bucket", "id", "n_words", F.coalesce("component", "id").alias("component"))
    more = _met(mine, texts, docs, width, threshold, chunk)
    if more is not None:
        first, classes = classes, components(links.unionAll(more))
        discard(first, more)
    discard(held, links)
    of_text = texts.join(classes.hint("merge"), "id", "left").select("d1", "d2", "rep", F.coalesce("component", "id").alias("component"))
    # The kept row of a class: the smallest doc_id, null last, then the smallest digest.
    best = of_text.groupBy("component").agg(F.min(F.struct(F.isnull("rep").alias("none"), F.col("rep").alias("class_id"), F.col("d1").alias("b1"), F.col("d2").alias("b2"))).alias("best"))
    of_text = of_text.join(best.hint("merge"), "component").select("d1", "d2", "best.class_id", "best.b1", "best.b2")
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("d1") == F.col("b1")) & (F.col("d2") == F.col("b2"))
    columns = ["doc_id", "d1", "d2", "k1", "k2", "n", "class_id", "kept", "n_words"]
    raw = F.min(F.struct("k1", "k2")).alias("raw")
    # Written before the join, which the engine can then split where a text has very many copies.
    grouped = scratch(worded.groupBy("doc_id", "d1", "d2", "n_words").agg(F.count("*").alias("n"), raw).select("*", "raw.*").drop("raw"), "members")
    grouped = grouped.join(of_text.hint("merge"), ["d1", "d2"]).withColumn("kept", keeps)
    alone = signed.where("n_words = 0").groupBy("doc_id", "d1", "d2", "n_words", "k1", "k2").agg(F.count("*").alias("n"))
    alone = alone.withColumn("class_id", F.col("doc_id")).withColumn("kept", F.lit(True))
    return grouped.select(columns).unionAll(alone.select(columns))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """Class of each document: doc_id, class_id (smallest doc_id of its class), kept (the one row of its class that stays), n_words."""
    return classed(docs, threshold, width, bands, rows, chunk).select("doc_id", "class_id", "kept", "n_words", "d1", "d2").distinct().drop("d1", "d2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class its kept row stays, once if it repeats. Rows go by doc_id and text, never by doc_id alone."""
    kept = scratch(classed(docs).where("kept").select("doc_id", "k1", "k2", "n", "n_words"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(1), F.col("text")).alias("x2"))
    own = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2"))
    twice = F.col("n") > 1
    left = rows.join(kept.where(~twice | (F.col("n_words") == 0)).hint("merge"), own, "left_semi").select("row")
    if not kept.where(twice & (F.col("n_words") > 0)).isEmpty():
        again = rows.join(kept.where(twice & (F.col("n_words") > 0)).hint("merge"), own, "left_semi")
        left = left.unionAll(again.groupBy(F.col("row.doc_id").alias("i"), "x1", "x2").agg(F.first("row").alias("row")).select("row"))
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: By definition, over all pairs: exact multiset overlap of runs of five words, and the closure of the links.
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {WIDTH - 2}, 2)), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS g FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS whole FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN t p ON p.doc_id = x JOIN t q ON q.doc_id = y WHERE common >= {THRESHOLD} * (p.whole + q.whole - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT doc_id, class_id, doc_id = class_id AS kept, CAST(len(w) AS BIGINT) AS n_words FROM d JOIN k ON doc_id = x
"""
