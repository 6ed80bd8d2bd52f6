import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probestack.llm.langid import MOST_PER_WORD, Memo, fit, identify, op1_language_id, stage, words_of

SCHEMA = "doc_id long, text string, lang string, score string"
EN = "the cat and the dog went to the house with a book"
DE = "der hund und die katze gingen mit einem buch in das haus"
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def train(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x") for i in range(40)] + [(99, "l'eau", None, "x"), (98, None, "en", "x"), (97, "", "de", "x")]
    return spark.createDataFrame(rows, SCHEMA)


def predict(model, texts):
    names, scores = model.predict(pa.array(texts, pa.string()), Memo())
    return names, scores.tolist()


def test_predictions_and_backoff(spark):
    model = fit(train(spark))
    names, scores = predict(model, ["the dog", "katze", "hundekatzen", None, "", "12 34 !", "²³", "Straße haus"])
    assert names[:3] == ["en", "de", "de"] and names[3:7] == ["und"] * 4 and names[7] == "de"
    assert all(0 <= s <= 1 for s in scores) and scores[3] == 0.0


def brute_force(counts, langs, text):
    """Score rows word by word from counts[lang][size][item]."""
    floor = {(x, s): np.log(0.5) - np.log(sum(counts[x][s].values()) + 1) for x in langs for s in range(6)}
    value = lambda x, s, item: np.log(counts[x][s][item]) - np.log(sum(counts[x][s].values()) + 1) if item in counts[x][s] else floor[x, s]
    known = [set().union(*[counts[x][s] for x in langs]) for s in range(6)]
    total = np.zeros(len(langs))
    for w in text.lower().split():
        if w in known[0]:
            row = np.array([value(x, 0, w) for x in langs])
        else:
            marked, rows = f"\x02{w}\x03", []
            for i in range(len(marked)):
                for s in range(min(5, len(marked) - i), 0, -1):
                    if marked[i : i + s] in known[s]:
                        rows.append([value(x, s, marked[i : i + s]) for x in langs])
                        break
            row = np.mean(rows, axis=0) if rows else np.zeros(len(langs))
        total += np.maximum(row, row.max() - MOST_PER_WORD)
    odds = np.exp((total - total.max()) / np.sqrt(len(text.split())))
    return langs[int(total.argmax())], float(odds.max() / odds.sum())


def test_scores_equal_brute_force(spark):
    docs = train(spark)
    model, langs = fit(docs), ["de", "en"]
    counts = {x: [{} for _ in range(6)] for x in langs}
    for _, text, lang, _ in docs.dropDuplicates(["doc_id", "text"]).collect():
        for w in (text or "").split() if lang else ():
            for s in range(6):
                for item in [w] if s == 0 else [f"\x02{w}\x03"[i : i + s] for i in range(len(w) + 3 - s)]:
                    counts[lang][s][item] = counts[lang][s].get(item, 0) + 1
    texts = ["the hund", "katzenhaus und book", "zzz the", "wenting doghouse", "buch " * 50, "qqq"]
    got = predict(model, texts)
    for text, name, score in zip(texts, *got, strict=True):
        want = brute_force(counts, langs, text)
        if text != "qqq":
            assert name == want[0]
        assert score == pytest.approx(want[1], abs=1e-5)


def test_a_rare_word_does_not_outvote_a_text(spark):
    rows = [(i, "shared only", "en", "x") for i in range(900)] + [(1000 + i, "shared other", "de", "x") for i in range(900)]
    model = fit(spark.createDataFrame(rows, SCHEMA))
    rows = model.score_words(*_keys("only"))
    assert rows.max() - rows.min() == pytest.approx(min(MOST_PER_WORD, np.log(900) - np.log(0.5)), abs=1e-5)


def _keys(*words):
    from probestack.llm.text import BLANK, split_words

    return split_words(pa.array(words), BLANK).hash, lambda at: [words[i] for i in at]


def test_rows_in_rows_out(spark):
    model = fit(train(spark))
    rows = [(1, "the book", "x", "a"), (1, "the book", "x", "a"), (None, "das buch", None, "b"), (3, None, "en", "c"), (4, "the " * 300_000, "en", "c")]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(spark.createDataFrame(rows, SCHEMA), model).collect())
    assert got == [(0, "de"), (1, "en"), (1, "en"), (3, "und"), (4, "en")]
    assert identify(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_nothing_to_learn_from(spark):
    unlabelled = spark.createDataFrame([(1, "abc", None, "x"), (2, "12", None, "x")], SCHEMA)
    assert predict(fit(unlabelled), ["abc"]) == (["und"], [0.0])
    assert fit(spark.createDataFrame([], SCHEMA)).langs == []
    assert [r.doc_id for r in stage(spark, unlabelled, "").collect()] == [1]


def test_ties_and_words_too_short_for_long_grams(spark):
    model = fit(spark.createDataFrame([(1, "a", "en", "x"), (2, "bb", "de", "x")], SCHEMA))
    assert predict(model, ["a", "bb", "bbb"])[0] == ["en", "de", "de"]
    even = fit(spark.createDataFrame([(1, "same", "en", "x"), (2, "same", "de", "x")], SCHEMA))
    assert predict(even, ["same"]) == (["de"], [0.5])


def test_the_sample_is_bounded_by_language_and_reproducible(spark):
    docs = train(spark).unionAll(spark.createDataFrame([(i, f"rare{chr(97 + i % 26)} mot", "fr", "x") for i in range(100, 104)], SCHEMA))
    a, b = fit(docs, sample=3), fit(docs.repartition(6), sample=3)
    assert a.langs == b.langs == ["de", "en", "fr"]
    for s in range(6):
        assert (a.keys[s] == b.keys[s]).all() and (a.value[s] == b.value[s]).all() and (a.lang[s] == b.lang[s]).all()
    one = fit(spark.createDataFrame([(1, EN, "en", "x")] * 50 + [(2, "word", "en", "x")], SCHEMA), sample=60)
    assert predict(one, ["word"])[0] == ["en"] and np.exp(one.floor[0, 0]) == pytest.approx(0.5 / (12 + 1 + 1))


def test_words():
    assert words_of("\u00c7a va? it's 2nd") == ["\u00e7a", "va", "it", "s", "nd"]
    assert words_of("caf\u00e9") == words_of("cafe\u0301") == ["caf\u00e9"] and words_of(None) == [] and words_of("123 \u00b2") == []
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940"  # vowel signs and a virama are marks within the word
    assert words_of(f"{hindi}, {hindi}") == [hindi, hindi]


def test_stage_decides_by_language_and_score(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(50, "the dog " * 20_000, None, "s"), (51, "123", "en", "s"), (52, None, "en", "s"), (None, "die katze", None, None), (53, "the katze", None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = lambda **kw: sorted(r.doc_id or 0 for r in stage(spark, docs, "", **kw).where("doc_id is null or doc_id >= 50").collect())
    assert stage(spark, docs, "").columns == docs.columns
    assert ids() == [0, 50, 53]
    assert ids(languages=("en",), min_score=0.7) == [50] and ids(min_score=1.01) == []
    assert stage(spark, docs.limit(0), "").collect() == []


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_query_learns_only_from_what_is_not_held_out(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    is_held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    # Held-out rows with wrong labels change nothing.
    docs.withColumn("lang", F.when(is_held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got, wrong = (op1_language_id(spark, d).collect() for d in (DIR, str(tmp_path)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, wrong)) and len(got) == len(truth)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(right) >= 0.97 * len(right) > 0
