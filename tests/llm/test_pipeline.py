import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from probestack.llm import near_dedup  # noqa: E402
from probestack.llm.langid import UNKNOWN, Memo, fit  # noqa: E402
from probestack.llm.mixing import mix_plan  # noqa: E402
from probestack.llm.shared import scratch  # noqa: E402
from tests.llm.test_near_dedup import brute_force  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    rnd = random.Random(7)
    words = {lang: [f"{lang}{rnd.choice('aeiou')}{rnd.randrange(300)}x".replace("0", "o") for _ in range(300)] for lang in ("en", "de")}
    item = [f"benchword{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = " ".join(rnd.choices(words[lang], k=rnd.randrange(5, 90)))
        if i % 20 == 0:
            text += " " + " ".join(item)
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), rows[i][2], "s1", 0) for i in range(30)]
    rows += [(300, None, "en", "s1", 0), (301, "123 456", "en", None, 7), (302, "", None, "s2", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item


def test_run_equals_brute_force(spark, tmp_path):
    rows, item = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = fit(docs).predict([r[1] for r in rows], Memo())[0]
    left = [r for r, lang in zip(rows, known, strict=True) if lang != UNKNOWN]
    assert len(rows) - len(left) == 3
    classes = brute_force([(r[0], r[1]) for r in left])
    left = [r for r in left if classes[r[0]] == r[0]]
    left = [r for r in left if " ".join(item) not in r[1]]
    plan = {r.doc_id: r.copies for r in mix_plan(spark.createDataFrame(left, SCHEMA)).collect()}
    want = sorted((*r, k) for r in left for k in range(1, plan[r[0]] + 1))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_copy"]
    assert sorted(map(tuple, got.collect())) == want


def test_stages_take_odd_rows(spark, tmp_path):
    tables(spark, str(tmp_path))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some words to keep here", "en", None, 3), (2, "some words to keep here", "en", None, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns[:5] == docs.columns
            out.collect()
    assert sorted(r.doc_id or 0 for r in near_dedup.stage(spark, docs, str(tmp_path)).collect()) == [0, 1, 2]


def test_stages_with_clashing_columns_and_long_texts(spark, tmp_path):
    tables(spark, str(tmp_path))
    clash = ["row", "own", "leaked", "k1", "n", "rate", "seed", "key", "copies", "by", "class_id", "kept", "score", "lang_pred", "x.y"]
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(i, t, lang, "s", 1, *["c"] * len(clash)) for i, t, lang in ((1, long, "en"), (2, long + " tail", "en"), (3, "kurz und gut", "de"), (None, "ohne nummer", "de"), (None, "ohne nummer", "de"), (5, None, None))]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"`{c}` string" for c in clash))
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns[: 5 + len(clash)] == [*(x.split()[0] for x in SCHEMA.split(", ")), *clash]
    left = {r.doc_id or 0: r for r in docs.collect()}
    assert set(left) <= {0, 1, 3} and all(r.row == "c" and r["x.y"] == "c" for r in left.values())


def test_an_unlabelled_corpus_is_kept(spark, tmp_path):
    rows, item = tables(spark, str(tmp_path))
    docs = spark.createDataFrame([(i, text, None, s, n) for i, text, _, s, n in rows if i < 120], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["language_id"](spark, docs, str(tmp_path)).count() == 120
    null_ids = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    assert stages["decontamination"](spark, null_ids, str(tmp_path)).count() == 120 - sum(" ".join(item) in r[1] for r in rows[:120])
