import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from probestack.llm import lm_score
from probestack.llm.lm_score import Model, bucket_of, levels_of, middle_of, print_of, score_texts, segment, tokens_of
from probestack.llm.text import U, mix

SCHEMA = "doc_id long, text string, held_out boolean, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute_force(rows):
    counts = Counter(t for _, text, held in rows if not held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {
        (i or 0): (len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)))
        for i, t, _ in rows
    }


def corpus():
    rnd = random.Random(1)
    words = [f"w{int(rnd.expovariate(0.05))}" for _ in range(3000)]
    rows = []
    for i in range(120):
        at = rnd.randrange(2900)
        rows.append((i, " ".join(words[at : at + rnd.randrange(80)]).capitalize(), i % 5 == 0))
    return rows + [(200, None, False), (201, "", True), (None, "w1 w2", False), (202, "only here\x00 now\nÀ", True), (203, "w1 " * 40_000, False), (204, "only here too", False)]


def test_base_score_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(6)
    want = brute_force(rows)
    for frequent in (100_000, 3):  # with 3, nearly all counts take the shuffle
        monkeypatch.setattr(lm_score.frequent_tokens, "__defaults__", (20_000, frequent))
        got = {(r.doc_id or 0): r for r in score_texts(frame).collect()}
        assert set(got) == set(want)
        for i, (n, known, train, base) in want.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a rare word", False)] * 3 + [(2, "another", True)] * 2
    got = sorted((r.doc_id, r.n_known, round(r.base_score, 9)) for r in score_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())
    one = sum(math.log10((3 + 1) / (12 + 4 + 1)) for _ in range(4))
    assert got == [(1, 4, round(one, 9))] * 3 + [(2, 1, round(math.log10(4 / 17) + math.log10(1 / 17), 9))] * 2
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.train_tokens for r in score_texts(spark.createDataFrame([(1, "a", True, "x")], SCHEMA)).collect()] == [0]


def test_held_out_texts_like_the_training_text_score_higher(spark):
    rnd = random.Random(2)
    order = [f"w{i}" for i in range(50)]
    train = [(i, " ".join(order[k : k + 20]), False) for i in range(200) for k in [rnd.randrange(30)]]
    held = [(1000, " ".join(order[5:25]), True), (1001, " ".join(rnd.sample(order[5:25], 20)), True)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame([(*r, "x") for r in train + held], SCHEMA)).collect()}
    assert got[1000].score > got[1001].score + 10 and abs(got[1000].base_score - got[1001].base_score) < 1e-6
    assert got[1000].score > got[1000].base_score


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(0)
    keys = mix(np.arange(20_000, dtype=U))
    counts = np.minimum(rng.zipf(1.6, len(keys)), 10**6)
    rows, buckets = [], 4
    for b in range(buckets):
        mine = bucket_of(keys, buckets) == b
        rows.append({"bucket": b, "bits": segment([(1, print_of(keys[mine]), levels_of(counts[mine]))], 1 << 30), "tokens": 1, "types": 1, "hot": b""})
    m = Model(rows, buckets, 1)
    got = m.levels(keys, 1)
    assert (got >= levels_of(counts)).all() and (got == levels_of(counts)).mean() > 0.95
    assert (m.levels(mix(np.arange(10**6, 10**6 + 20_000, dtype=U)), 1) > 0).mean() < 0.05
    bounded = segment([(1, print_of(keys), levels_of(counts))], 40_000)
    assert len(bounded) * 8 <= 40_008
    assert middle_of(levels_of(np.array([0, 1, 2, 3, 4, 7]))).tolist() == [0, 1, 2.5, 2.5, 5.5, 5.5]


def test_tokens():
    t = tokens_of(pa.array(["A b", None, "a"]))
    assert t.counts.tolist() == [3, 1, 2] and t.token[0] == t.token[4] and t.token[2] == t.token[3] == lm_score.END
    assert t.before[0] == t.before[3] == t.before[4] == lm_score.START and t.before[1] == t.token[0]


def quantised_scores(rows):
    """Scores by exact counts, quantised as the filter does."""
    quantised = lambda c: float(middle_of(levels_of(np.array([c])))[0])
    ones, twos = Counter(), Counter()
    for _, text, held in rows:
        if not held:
            words = tokens(text)
            ones.update(words)
            twos.update(zip(["start", *words], words, strict=False))
    whole, texts = sum(ones.values()) + len(ones) + 1, sum(not held for _, _, held in rows)
    out = {}
    for i, text, _ in rows:
        words, total = tokens(text), 0.0
        for v, w in zip(["start", *words], words, strict=False):
            context, count = texts if v == "start" else quantised(ones[v]), quantised(ones[w])
            pair = min(quantised(twos[v, w]), context, count)
            total += math.log10((pair + lm_score.PRIOR * (count + 1) / whole) / (context + lm_score.PRIOR))
        out[i or 0] = total
    return out


def test_scores_keep_every_event_whatever_the_bytes(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(score_texts, "__defaults__", tuple(400 for _ in score_texts.__defaults__ or ()) or None)  # a bound on the filter, if it has one
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2_000, raising=False)
    got = {(r.doc_id or 0): r.score for r in score_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)).collect()}
    want = quantised_scores(rows)
    near = [abs(got[i] - want[i]) <= 0.03 * abs(want[i]) + 0.3 for i in want]  # false positives of the filter may raise a few
    assert sum(near) >= 0.95 * len(near)


def test_bigrams_that_occur_once_are_held(spark):
    train = [(i, f"left{i} right{i}", False) for i in range(40)]
    held = [(100 + i, f"left{i} right{i}", True) for i in range(40)]
    rows = train + held + [(200 + i, f"left{i} right{(i + 1) % 40}", True) for i in range(40)]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    want = quantised_scores(rows)
    assert sum(abs(got[i] - want[i]) < 1e-9 for i in want) >= 0.9 * len(want)
    assert sum(got[100 + i] > got[200 + i] + 0.1 for i in range(40)) >= 36
