import random

import pytest
from pyspark.sql import functions as F

from probestack.functions import tokens as T
from probestack.functions import vectors as V
from probestack.operators import clustering, pooling, sampling, shards, similarity, stats, vocabulary


def test_shard_walks():
    assert shards.first_fit([5, 6, 3, 9, 1], 10) == [0, 1, 0, 2, 0]
    assert shards.first_fit([5, 5], 10) == [0, 1] and shards.first_fit([12, 12], 10) == [0, 1]
    assert shards.sequential([6, 6, 3], 10) == [0, 0, 1] and shards.sequential([5, 5, 1], 10) == [0, 0, 0]
    assert shards.first_fit([], 1) == shards.sequential([], 1) == []


def test_first_fit_equals_a_scan_of_all_shards():
    rng = random.Random(3)
    for _ in range(60):
        durations = [rng.choice([0.0, 1.5, rng.random() * 12, 30.0]) for _ in range(rng.randrange(0, 70))]
        totals, want = [], []
        for d in durations:
            at = next((i for i, t in enumerate(totals) if (t == 0.0 if d > 10 else t + d < 10)), None)
            if at is None:
                totals.append(0.0)
                at = len(totals) - 1
            totals[at] += d
            want.append(at)
        assert shards.first_fit(durations, 10) == want
    assert len(set(shards.first_fit([6.0] * 50_000, 10))) == 50_000


def test_pack_per_group(spark):
    items = spark.createDataFrame([("a", 2, 6.0), ("a", 1, 5.0), ("b", 1, 5.0), ("a", 3, 3.0)], "g string, k int, d double")
    got = {(r.g, r.k): r.shard for r in shards.pack(items, "g", ["k"], "d", 10.0).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 0, ("b", 1): 0}


def test_phones_and_paths(spark):
    rows = [("AH0",), ("T",), ("sil",), ("spn",), ("sp",), ("",), (None,)]
    df = spark.createDataFrame(rows, "l string").select(T.phone(F.col("l")).alias("t")).where(T.is_token(F.col("t")))
    assert [r.t for r in df.collect()] == ["ah", "t", "SIL"]
    one = spark.createDataFrame([("84-121123-0001",)], "u string").select(T.audio_path("/d", F.col("u")).alias("p")).first().p
    assert one == "/d/84/121123/84-121123-0001.flac"


@pytest.mark.parametrize(
    ("start", "end", "n", "middle", "want"),
    [(0.05, 0.11, 100, False, (2, 6)), (0.0, 0.16, 100, True, (3, 5)), (0.14, 0.14, 100, False, (7, 8)), (0.0, 0.2, 9, False, (0, 9))],
)
def test_segment_frames(spark, start, end, n, middle, want):
    a, b = T.segment_frames(F.lit(start), F.lit(end), 0.02, F.lit(n), middle)
    assert tuple(spark.range(1).select(a, b).first()) == want


def test_truth_frames(spark):
    a, b = T.truth_frames(F.lit(0.05), F.lit(0.05), 0.02, F.lit(100))
    assert tuple(spark.range(1).select(a, b).first()) == (3, 4)
    a, b = T.truth_frames(F.lit(0.0), F.lit(9.0), 0.02, F.lit(100))
    assert tuple(spark.range(1).select(a, b).first()) == (0, 100)
    a, b = T.truth_frames(F.lit(2.0), F.lit(2.5), 0.02, F.lit(100))  # begins at the end
    assert tuple(spark.range(1).select(a, b).first()) == (None, None)
    a, b = T.truth_frames(F.lit(1.97), F.lit(1.97), 0.02, F.lit(100))
    assert tuple(spark.range(1).select(a, b).first()) == (99, 100)


def test_word_pair_forms(spark):
    rows = [("rw", "1,a,b,3.5"), ("simverb-3500", "x,2,c,d,y"), ("men", "1,e-n,f-v,9"), ("men", "bad")]
    df = spark.createDataFrame(rows, "task string, line string").select(T.word_pair(F.col("task"), F.split("line", ",")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [("a", "b", 3.5), ("c", "d", 2.0), ("e", "f", 9.0), (None, None, None)]


def test_pooling(spark):
    f = spark.createDataFrame([("a", i, [float(i + 1), 0.0]) for i in range(5)], "utt_id string, frame long, vec array<double>")
    got = {(r.out, r.dim): r.value for r in pooling.strided_pool(f, 2, 2).collect()}
    assert got == {(0, 0): 1.5, (0, 1): 0.0, (1, 0): 3.5, (1, 1): 0.0}
    stacked = {r.out: r.vec for r in pooling.stack_frames(f, 2, 2).collect()}
    assert stacked == {0: [1, 0, 2, 0], 1: [3, 0, 4, 0], 2: [5, 0, 0, 0]}
    seg = spark.createDataFrame([("a", 1, 1, 3), ("a", 2, 3, 3)], "utt_id string, segment_id int, first long, last long")
    pooled = {(r.segment_id, r.dim): (r.value, r.n) for r in pooling.segment_pool(f, seg).collect()}
    assert pooled == {(1, 0): (2.5, 2), (1, 1): (0.0, 2)}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], {"x": 1.0, "y": 2.0}, 1)], "a array<float>, b array<float>, m map<string,double>, i int")
    r = df.select(V.norm("a").alias("n"), V.cosine("a", "b").alias("c"), V.cosine("a", "a").alias("s"), V.dense(F.col("m"), ["y", "z", "x"]).alias("d"), V.one_hot(F.col("i"), 3).alias("o"), V.standardised("a", 0.0).alias("z")).first()
    assert r.n == 5 and r.c is None and r.s == pytest.approx(1) and r.d == [2, 0, 1] and r.o == [0, 1, 0] and r.z == pytest.approx([-1, 1])


def test_sampling(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(90)], "token string, id int")
    one = sorted(map(tuple, sampling.quota_sample(df, "token", 10, ["id"]).collect()))
    assert one == sorted(map(tuple, sampling.quota_sample(df.repartition(5), "token", 10, ["id"]).collect())) and len(one) == 20
    assert sampling.sample_n(df, 7, ["id"]).count() == 7
    folds = sampling.stratified_folds(df, "token", "id").groupBy("token", "fold").count().collect()
    assert {r["count"] for r in folds if r.token == "a"} == {6} and len(folds) == 20
    few = sampling.stratified_folds(df.limit(3), "token", "id", 10)
    assert few.count() == 3


def test_presets_are_applied(spark):
    rows = spark.createDataFrame([("SIL" if i % 7 == 0 else f"t{i % 3}" if i % 5 else "few", i) for i in range(2100)], "token string, id int")
    dev = {r.token: (r.n, r.cnt) for r in sampling.token_sample(rows, "phone", "dev-clean", ["id"]).groupBy("token").agg(F.count("*").alias("n"), F.max("cnt").alias("cnt")).collect()}
    assert set(dev) == {"t0", "t1", "t2", "few"} and all(n == min(200, cnt) for n, cnt in dev.values())
    train = sampling.token_sample(rows, "phone", "train-clean-100", ["id"]).groupBy("token").agg(F.count("*").alias("n"), F.max("cnt").alias("cnt"), F.max("quota").alias("q")).collect()
    least = None
    for r in sorted(train, key=lambda r: (-r.cnt, r.token)):  # bounds fall to the smallest count met
        least = r.cnt if least is None else min(least, r.cnt)
        assert r.n == r.q == least
    words = spark.createDataFrame([(f"w{i % 20}", i) for i in range(5000)] + [("<unk>", -1)] * 9, "token string, id int")
    some = sampling.token_sample(words, "word", "dev", ["id"], n_words=6)
    assert sorted((r.token, r["count"]) for r in some.groupBy("token").count().collect()) == sorted((t, 15) for t in ("w0", "w1", "w10", "w11", "w12", "w13"))


def test_vector_means_and_lloyd(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", None), ("a", [9.0, None]), ("b", [0.0, 1.0])], "k string, vec array<double>")
    assert sorted((r.k, r.vec, r.n) for r in pooling.vector_means(rows, ["k"]).collect()) == [("a", [2.0, 3.0], 2), ("b", [0.0, 1.0], 1)]
    points = spark.createDataFrame([([0.0],), ([1.0],), ([10.0],), ([12.0],)], "vec array<double>")
    centres = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [99.0])], "cluster int, vec array<double>")
    assert sorted((r.cluster, r.vec, r.n) for r in clustering.lloyd(points, centres, 2).collect()) == [(0, [0.5], 2), (1, [11.0], 2), (2, [99.0], 0)]


def test_incomplete_pairs_are_reported(spark):
    pairs = spark.createDataFrame([("p", 0, 1), ("p", 0, 2), ("q", 0, 1), ("r", 1, 2), ("r", 0, 2)], "pair_id string, idx_a long, idx_b long")
    gold = spark.createDataFrame([("p", 1.0), ("q", 2.0), ("r", 0.5)], "pair_id string, score double")
    vectors = spark.createDataFrame([(layer, i, v) for layer in (0, 1) for i, v in enumerate([[1.0, 0.0], [1.0, 1.0], [0.0, 1.0 + layer]])], "layer int, row_id long, vec array<double>")
    found = similarity.sentence_similarity(pairs, gold, vectors, 2, ["layer"])
    assert sorted((r.layer, r.pair_id, r.n, r.complete) for r in found.collect()) == [(k, p, n, n == 2) for k in (0, 1) for p, n in (("p", 2), ("q", 1), ("r", 2))]
    rho = similarity.sentence_rho(found, ["layer"]).collect()
    assert [(r.n, r.n_incomplete, r.rho is None or round(abs(r.rho), 6) == 1) for r in rho] == [(2, 1, True)] * 2


def test_quotas(spark):
    counts = spark.createDataFrame([("x", 20, 0), ("y", 3, 1), ("z", 20, 2)], "token string, cnt long, first int")
    got = [(r.low, r.high) for r in sampling.shrinking_quotas(counts, 5, 9, [F.col("first")]).orderBy("first").collect()]
    assert got == [(5, 9), (3, 3), (3, 3)]
    free = {r.token: (r.low, r.high) for r in sampling.independent_quotas(counts, 5, 9).collect()}
    assert free == {"x": (5, 9), "y": (3, 3), "z": (5, 9)}
    assert all(r.low <= r.quota <= r.high for r in sampling.independent_quotas(counts, 5, 9).collect())
    assert sampling.preset("word", "train-clean", 500).least == 600 and sampling.preset("phone", "dev").most == 200
    with pytest.raises(ValueError):
        sampling.preset("word", "train", 123)


def test_information_and_ranks(spark):
    same = spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "a int, b int")
    r = stats.mutual_information(same, "a", "b").first()
    assert r.mi == pytest.approx(r.h_a) == pytest.approx(stats.entropy(same, "a").first().h)
    free = spark.createDataFrame([(i % 4, i // 4 % 5) for i in range(40)], "a int, b int")
    assert stats.mutual_information(free, "a", "b").first().mi == pytest.approx(0, abs=1e-12)
    ties = spark.createDataFrame([("t", 1.0, 1.0), ("t", 2.0, 2.0), ("t", 2.0, 3.0), ("t", 3.0, 4.0)], "task string, x double, y double")
    assert stats.spearman(ties, "x", "y", ["task"]).first().rho == pytest.approx(0.9486833)
    scores = spark.createDataFrame([(0.5, 10), (0.9, 30)], "rho double, n int")
    assert tuple(stats.averages(scores).first()) == (2, pytest.approx(0.8), pytest.approx(0.7))


def test_best_by_and_global_rank(spark):
    df = spark.createDataFrame([("a", float("nan"), 0), ("a", 1.0, 2), ("a", 1.0, 1), ("b", None, 5)], "k string, s double, g int")
    assert sorted((r.k, r.g) for r in stats.best_by(df, ["k"], "s", ["g"]).collect()) == [("a", 1), ("b", 5)]
    many = spark.range(1000).selectExpr("id", "id * 7919 % 1009 as v")
    got = stats.global_rank(many, [F.col("v")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [r.v for r in got] == sorted(r.v for r in got)


def test_ranks_hold_when_written_with_other_columns(spark, tmp_path):
    """Half a million rows over 16 partitions, with columns that one side of the plan doesn't need."""
    n = 500_000
    rows = spark.range(0, n, 1, 16).select("id", F.pmod(F.col("id") * 7919, F.lit(104_729)).alias("v"), F.concat(F.lit("x"), F.col("id")).alias("text"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("k"))
    stats.global_rank(rows, [F.desc("v"), F.col("id")], partitions=16).write.parquet(f"{tmp_path}/r")
    got = spark.read.parquet(f"{tmp_path}/r")
    assert got.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count("text")).first() == (n, 1, n, n)
    want = sorted((-((i * 7919) % 104_729), i) for i in range(n))
    assert [r.id for r in got.where("rank % 9973 = 1").orderBy("rank").collect()] == [want[k][1] for k in range(0, n, 9973)]
    top = vocabulary.ranked(rows.select(F.col("text").alias("token"), F.col("v").alias("cnt"), "k"))
    assert top.agg(F.count_distinct("rank"), F.max("rank"), F.count("k")).first() == (n, n, n)
    stats.running_min(rows, [F.col("id")], "v", "low", partitions=16).write.parquet(f"{tmp_path}/m")
    low, wrong = n, 0
    found = {r.id: r.low for r in spark.read.parquet(f"{tmp_path}/m").select("id", "low").toLocalIterator()}
    for i in range(n):
        low = min(low, (i * 7919) % 104_729)
        wrong += found[i] != low
    assert wrong == 0
    sums = stats.prefix_sums(rows.select("id", "v"), [F.col("id")], {"v": "before"}, partitions=16)
    assert sums.where("id % 99991 = 7").select("id", "before").orderBy("id").collect() == [(i, sum((j * 7919) % 104_729 for j in range(i))) for i in range(7, n, 99_991)]
    within = stats.rank_within(rows, ["k"], [F.col("v"), F.col("id")], partitions=16).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert len(within) == 3 and all(r.n == r.d == r.m for r in within)


def test_average_rank_of_null_keys_and_ties(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 0.0), ("a", 5.0), ("a", 5.0), ("a", 7.0)], "k string, v double")
    got = sorted((r.k or "", r.v, r.rank) for r in stats.average_ranks(rows, {"v": "rank"}, ["k"]).collect())
    assert got == [("", 0.0, 1.0), ("", 1.0, 2.5), ("", 1.0, 2.5), ("a", 5.0, 1.5), ("a", 5.0, 1.5), ("a", 7.0, 3.0)]


def test_vocabulary(spark):
    t = spark.createDataFrame([("train-clean-100", "a"), ("train-clean-360", "a"), ("train-other-500", "b"), ("dev", "c")], "split string, token string")
    got = sorted((r.split, r.token, r["count"]) for r in vocabulary.combine(t).groupBy("split", "token").count().collect())
    assert got == [("train", "a", 2), ("train", "b", 1), ("train-clean", "a", 2)]
    ranked = vocabulary.ranked(vocabulary.token_counts(t)).orderBy("rank").collect()
    assert [r.token for r in ranked] == ["a", "b", "c"]
    x, y = (spark.createDataFrame([(w, 1) for w in ws], "word string, n int") for ws in ("ab", "bc"))
    whole, clashes = vocabulary.disjoint_union([x, y], "word")
    assert whole.count() == 4 and [r.word for r in clashes.collect()] == ["b"]
    assert [r.word for r in vocabulary.known_words([x, y], spark.createDataFrame([("b", 1), ("z", 1)], "token string, cnt int")).collect()] == ["b"]
    assert [r.token for r in vocabulary.top(spark.createDataFrame([("<unk>", 9), ("q", 3), ("p", 3)], "token string, cnt long"), 1).collect()] == ["p"]


def test_similarity(spark):
    pairs = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "a", "zz", 2.0), ("u", "a", "zz", 2.0)], "task string, w1 string, w2 string, score double")
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "word string, vec array<double>")
    cos = {(r.task, r.w2): r.cos for r in similarity.pair_cosines(pairs, emb).collect()}
    assert cos["t", "b"] == pytest.approx(0.5**0.5) and cos["t", "zz"] is None
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("zz", 1)], "token string, cnt long")
    kept = similarity.filter_pairs(pairs, counts, 4)
    assert sorted(map(tuple, similarity.retention(pairs, kept).collect())) == [("t", 2, 1, 0.5), ("u", 1, 0, 0.0)]
    rec = spark.createDataFrame([("p", s, i) for i, s in enumerate("aabb")], "pair_id string, side string, row_id long")
    assert similarity.speaker_pairs(rec).count() == 4
    gold = similarity.gold_scores(spark.createDataFrame([("p", 1.0), ("p", 1.0), ("q", 1.0), ("q", 2.0)], "pair_id string, score double"))
    assert {r.pair_id: r.consistent for r in gold.collect()} == {"p": True, "q": False}
