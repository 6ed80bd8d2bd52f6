import re

import numpy as np
import pyarrow as pa

from probestack.llm import text
from probestack.llm.text import ALNUM, BLANK, bounded, gram_hashes, split_words

PATTERNS = {"alnum": (ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "blank": (BLANK, re.compile(r"[^\x20\x09-\x0D]+"))}
TEXTS = ["Hello World, äÖ x2", None, "", " the  the", "a\x00b c", "x" * 300, "naïve – “quotes” 日本", "A" * 5 + "\n" + "a" * 5, "tail"]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def test_words_equal_the_patterns(monkeypatch):
    for block in (1 << 20, 7):  # with 7, words are hashed in many blocks
        monkeypatch.setattr(text, "SLICE_BYTES", block)
        for table, pattern in PATTERNS.values():
            words = split_words(pa.array(TEXTS), table)
            want = [pattern.findall(lower(t)) for t in TEXTS]
            assert words.counts.tolist() == [len(w) for w in want]
            seen = dict(zip((w for ws in want for w in ws), words.hash.tolist(), strict=True))
            flat = [w for ws in want for w in ws]
            assert [seen[w] for w in flat] == words.hash.tolist() and len(set(seen.values())) == len(seen)


def test_grams():
    words = split_words(pa.array(["a b c d e f", "a b c d e", None, "a", "b c d e f"]), ALNUM)
    grams, doc = gram_hashes(words, 5)
    assert doc.tolist() == [0, 0, 1, 3, 4] and grams[0] == grams[2] and grams[1] == grams[4] and len(set(grams.tolist())) == 3


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (3, 3, 50, 0, 4, 4, 4)] + [None])], names=["text"])
    parts = [p.column("text").to_pylist() for p in bounded([batch], "text", 10)]
    assert [len(p) for p in parts] == [2, 1, 3, 2] and sum(map(len, parts)) == 8
    assert np.sum([len(x or "") for p in parts for x in p]) == 68
