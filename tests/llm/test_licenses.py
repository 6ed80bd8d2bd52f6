import random
import re
import time

import regex

from probestack.llm.licenses import ALL, BASE, Notice, base_places, fuzzy_spans, joined_words, op5_licenses, scan_licenses

SCHEMA = "doc_id long, text string, n_words long, spans int"


def test_base_places():
    text = joined_words("Released UNDER the MIT-License. (CC BY-NC) Apache License, Version 2.0; cc by nc")
    assert text == "released under the mit license cc by nc apache license version 2 0 cc by nc"
    assert base_places(text) == [("mit", 1), ("cc-by-nc", 5), ("apache-2", 8), ("cc-by-nc", 13)]
    assert base_places("funder the mit license") == [] and base_places("") == []


def test_fuzzy_search_equals_a_scan_of_every_place():
    rnd = random.Random(4)
    letters = "abcdeil nst"
    for _ in range(60):
        n = rnd.choice(ALL)
        phrase = list(n.phrase)
        for _ in range(rnd.randrange(0, n.edits + 2)):
            k = rnd.randrange(len(phrase))
            phrase[k : k + rnd.randrange(2)] = rnd.choice(letters)
        noise = lambda: "".join(rnd.choices(letters, k=60)).strip()
        text = joined_words(f"{noise()} {''.join(phrase)} {noise()} {n.phrase}")
        bound = f"{{e<={n.edits}}}" if n.edits else ""
        every = regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n.phrase, literal_spaces=True)}){bound}(?![^ ])")
        assert list(n.matches(text)) == [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in every.finditer(text)]


def test_edits_and_spans():
    spans = fuzzy_spans("xx released under the mit licence yy")
    assert [(s.label, s.start_word, s.end_word, s.edits) for s in spans] == [("mit", 2, 6, 1)]
    assert fuzzy_spans("co by nc") == [] and fuzzy_spans("under the limit") == []
    assert Notice("cc by nc", "x").edits == 0 and set(BASE.values()) == {"mit", "apache-2", "cc-by-nc"}


def test_rows(spark):
    rows = [(1, "Under the MIT License", 1, 2), (1, "Under the MIT License", 1, 2), (2, None, 1, 1), (3, "", 1, 1), (None, "cc by nc", 1, 1), (5, "word " * 50_000 + "cc by-nc", 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_words, len(r.places), [p.word for p in r.places]) for r in scan_licenses(frame).collect())
    assert got == [(0, 3, 1, [0]), (1, 4, 1, [0]), (1, 4, 1, [0]), (2, 0, 0, []), (3, 0, 0, []), (5, 50_003, 1, [50_000])]
    assert scan_licenses(frame.limit(0)).collect() == []


def test_many_hits_in_a_long_text_take_linear_time():
    text = "under the mit license cc by nc and " * 80_000
    began = time.time()
    places, spans = base_places(text.strip()), fuzzy_spans(text.strip())
    assert len(places) == 160_000 and places[-1] == ("cc-by-nc", 8 * 80_000 - 4) and len(spans) == 160_000
    assert [s.start_word for s in spans if s.label == "mit"] == list(range(0, 640_000, 8))
    assert time.time() - began < 30


def test_query_equals_a_word_by_word_search(spark, tmp_path):
    """All of the contract's columns; fuzzy labels and the score come from a scan of every place."""
    rnd = random.Random(8)
    phrases = [*BASE, "under the mit licence", "gnu general publik license", "apache license version", "mozilla public license"]
    rows = [(i, " ".join(rnd.choice([rnd.choice(phrases).title(), "some", "WORDS,", "été", "the"]) for _ in range(rnd.randrange(12))), "x") for i in range(80)]
    rows += [(100, None, "x"), (101, "", None), (None, "CC-BY-NC", "x"), (1, rows[1][1], "x"), (102, "under the mit license " * 3 + "cc by nc", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
        places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels, score, joined = {x for _, x in places}, 1.0 if places else 0.0, " ".join(words)
        for n in ALL:
            bound = f"{{e<={n.edits}}}" if n.edits else ""
            for m in regex.finditer(rf"(?e)(?<![^ ])(?:{regex.escape(n.phrase, literal_spaces=True)}){bound}(?![^ ])", joined):
                labels.add(n.label)
                score = max(score, 1 - sum(m.fuzzy_counts) / len(n.phrase))
        starts = [i for i, _ in places]
        want.append((doc_id or 0, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9)))
    got = op5_licenses(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got), key=repr) == sorted(want, key=repr)
    assert [x.label for r in scan_licenses(spark.createDataFrame([(1, "my own notice")], "doc_id long, text string"), notices={"own notice": "own"}).collect() for x in r.spans] == ["own"]
