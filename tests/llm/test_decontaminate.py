import itertools
import random

import pytest
from pyspark.sql import functions as F

from probestack.llm import decontaminate
from probestack.llm.decontaminate import contaminated, stage

rnd = random.Random(2)
ITEM = [f"q{i}" for i in range(30)]


def noise(n):
    return [f"n{rnd.randrange(10**6)}" for _ in range(n)]


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_matched, r.n_item_words) for r in contaminated(d, b).collect()}


@pytest.mark.parametrize("most", [1_000_000, 9])  # with 9, the benchmark is cut into several broadcasts
def test_substitutions_insertions_and_clean_texts(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
    exact = noise(50) + ITEM + noise(50)
    changed = list(ITEM)
    for i in (3, 9, 14, 21, 27):
        changed[i] = "other"
    inserted = ITEM[:15] + ["extra"] + ITEM[15:]
    docs = [
        (1, " ".join(exact)),
        (2, "Some, " + ", ".join(noise(9) + changed)),
        (3, " ".join(noise(5) + inserted)),
        (4, " ".join(noise(300))),
        (5, " ".join(ITEM[:10] + noise(100))),  # a third of the item
        (10, " ".join(noise(9) + ITEM[4:18] + noise(100))),  # fourteen words in a row
        (6, " ".join(ITEM).upper()),
        (7, None),
        (8, ""),
        (1, " ".join(exact)),
        (9, " ".join(noise(4) + ITEM[2:])),  # starts within
        (None, " ".join(ITEM)),
    ]
    got = run(spark, docs, [(70, " ".join(ITEM)), (71, None), (72, ""), (73, "one two")])
    assert got == {(1, 70): (30, 30), (2, 70): (25, 30), (3, 70): (30, 30), (6, 70): (30, 30), (9, 70): (28, 30), (10, 70): (14, 30), (None, 70): (30, 30)}


def test_short_items_repeats_and_empty_tables(spark):
    short = "alpha beta gamma delta epsilon zeta"
    got = run(spark, [(1, f"x {short} y"), (2, "alpha beta gamma delta"), (3, short)], [(5, short), (5, short), (6, "alpha beta gamma delta")])
    assert got == {(1, 5): (6, 6), (3, 5): (6, 6), (1, 6): (4, 4), (2, 6): (4, 4), (3, 6): (4, 4)}
    tiny = [(1, "beta"), (2, "Gamma, delta"), (3, "a b c"), (4, "zeta alpha"), (5, "...")]
    assert run(spark, [(1, "alpha beta gamma delta alpha beta"), (2, "x y"), (3, None)], tiny) == {(1, 1): (1, 1), (1, 2): (2, 2)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contaminated(empty, spark.createDataFrame([(1, short)], "item_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, short)], "doc_id long, text string")
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_stage_goes_by_text(spark, tmp_path):
    item = " ".join(ITEM)
    spark.createDataFrame([(1, item), (2, "one two"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    far = " ".join(noise(60_000))
    rows = [(None, item, "a"), (None, "one two three", "b"), (5, item, "c"), (5, "clean text of its own", "d"), (6, None, "e"), (7, f"{far} {item} {far}", "f"), (8, far, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.item_id for r in out.collect()) == ["b", "d", "e", "g"]
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    got = contaminated(docs.withColumnRenamed("item_id", "overlap"), spark.read.parquet(f"{tmp_path}/benchmark.parquet").withColumn("doc_id", F.lit("x"))).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (0, 2), (5, 1), (7, 1)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM))], "doc_id long, text string")
    plan = contaminated(docs, spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_every_placement_of_substitutions_in_short_items(spark):
    own = random.Random(7)
    items, docs, want = [], [], {}
    for n in (5, 6, 7, 8, 9, 10, 12, 15, 20, 24):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        least = -(-3 * n // 5)
        for changes in (n - least, n - least + 1)[: 2 if least <= 13 else 1]:  # more words might still be dense
            ways = list(itertools.combinations(range(n), changes)) if n < 8 else [own.sample(range(n), changes) for _ in range(15)]
            for way in ways:
                doc = len(docs)
                docs.append((doc, " ".join(noise(own.randrange(4)) + [w if k not in way else "other" for k, w in enumerate(words)] + noise(3))))
                if changes == n - least:  # by brute force, n - changes words of the only alignment match
                    want[doc, n] = (least, n)
    got = run(spark, docs, items)
    assert not {k: got.get(k) for k in want if got.get(k) != want[k]} and not {k: got[k] for k in got if k not in want}
