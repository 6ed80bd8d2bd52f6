import random

import pytest
from pyspark.sql import functions as F

from probestack.llm.token_counts import EDITS, VOCABULARY, TokenTree, count_tokens, encoder, example_edits


@pytest.fixture(scope="module")
def count():
    with open(VOCABULARY, "rb") as f:
        encode = encoder(f.read()).encode_ordinary
    return lambda text: len(encode(text))


def test_edits_equal_encoding_anew(count):
    rnd = random.Random(1)
    alphabet = " \n\tab'sllÜé42  .,!日本<|endoftext|>'’\r\u00a0\u0301\u2028"
    for size in (1, 16, 128):
        for _ in range(40):
            text = "".join(rnd.choices(alphabet, k=rnd.randrange(0, 900)))
            tree = TokenTree(text, count, size)
            assert tree.n_tokens == count(text)
            for _ in range(8):
                a = rnd.randrange(len(text) + 1)
                b = min(len(text), a + rnd.choice([0, 0, 1, 7, 200]))
                new = "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 5, 300])))
                text = text[:a] + new + text[b:]
                tree.edit(a, b, new)
                assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), count(text))


def test_only_touched_regions_are_encoded(count):
    text = "some words in a row " * 20_000
    tree = TokenTree(text, count)
    tree.edit(200_000, 200_005, "other")
    assert tree.n_tokens == count(text[:200_000] + "other" + text[200_005:]) and tree.encoded <= 4
    tree.edit(10**9, 10**9 + 5, "end")
    assert tree.text().endswith("end")
    tree.edit(5, 2, "x")
    assert tree.text()[5] == "x"


def test_rows(spark, count):
    rows = [(1, "Hello world, hello"), (1, "Hello world, hello"), (None, "a b"), (3, None), (4, ""), (5, "word " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    edited = frame.withColumn("edits", F.when(F.col("doc_id").isNull(), None).otherwise(example_edits(F.col("doc_id"), F.col("text"))))
    places = {(r.doc_id, r.text): [(e.start, e.stop, e.text) for e in r.edits or []] for r in edited.collect()}
    got = count_tokens(edited).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for (i, text), edits in places.items():
        after = text or ""
        for a, b, new in edits:
            a, b = min(a, len(after)), min(max(a, b), len(after))
            after = after[:a] + new + after[b:]
        r = by_id[i]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited, r.n_edits) == (count(text or ""), count(after), len(after), len(edits))
    assert by_id[None].n_edits == 0 and by_id[3].n_edits == len(EDITS)
    assert count_tokens(edited.limit(0)).collect() == []


def test_texts_without_spaces_and_long_insertions(count):
    rnd = random.Random(4)
    for text in ("\u6f22\u5b57\u3068\u8a00\u8449\u3002" * 5_000, "0a1b2c3d" * 4_000, "x_y-z.(w)" * 4_000, "line\nline\tline\n" * 2_000):
        tree = TokenTree(text, count)
        assert len(tree.leaves) > 100 and tree.n_tokens == count(text)
        before = tree.encoded
        tree.edit(9_000, 9_003, "new")
        assert tree.encoded - before <= 4 and tree.n_tokens == count(text[:9_000] + "new" + text[9_003:])
    text = "some words in a row " * 1_000
    tree = TokenTree(text, count)
    text = text[:10_000] + "inserted words, " * 50_000 + text[10_000:]
    tree.edit(10_000, 10_000, "inserted words, " * 50_000)
    assert tree.n_tokens == count(text) and max(map(len, tree.leaves)) < 600
    for _ in range(20):
        at, before = rnd.randrange(len(text)), tree.encoded
        tree.edit(at, at + 3, "!x")
        text = text[:at] + "!x" + text[at + 3 :]
        assert tree.encoded - before <= 8
    assert tree.text() == text and tree.n_tokens == count(text)
