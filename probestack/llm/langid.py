"""Language identification with word-first backoff.

Known words are scored by log frequency per language. A word that is not known is covered by
character n-grams of the word between boundary marks: at each place the longest known n-gram
(MAX_GRAM down to 1) gives its log frequency per language, and the mean over places is the word's
score; a gram or word unknown in one language gets that table's floor there. As part of the model, a
word is evidence of at most MOST_PER_WORD nats for one language against another, so that one rare
word cannot outvote a text. A text's score for a language is the sum over its words; `score` is the
posterior of the best language under equal priors, tempered for the number of words so that short
texts stay uncertain.

Words are runs of letters and combining marks (digits, punctuation and white space split them),
lower-cased and composed (NFC). A text with words of no known gram falls back to the language with
most training words.

The model is fitted on a bounded sample of labelled rows: of every language the SAMPLE rows of
smallest hash of (doc_id, text) that are labelled and allowed for training; rows that repeat both
count once. Every word and n-gram of the sample is in the model, so its size is bounded by SAMPLE
texts a language.

Defined cases: a null text or one without a letter is `und` with score 0; null labels are not
trained on; a null doc_id counts as not held out; repeated rows are predicted alike, once each; no
labelled row at all leaves every text `und`; other columns are ignored. Ties go to the first
language in code-point order. Words and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probestack.llm.shared import discard, held_out, read_table, scratch, small_side
from probestack.llm.text import BLANK, U, Words, bounded, mix, split_words, streams, string_buffers

#: Labelled rows of each language that the model learns from.
SAMPLE = 1000
MAX_GRAM = 5
UNKNOWN = "und"
MOST_PER_WORD = 8.0
#: The pipeline keeps documents whose language has at least this posterior.
MIN_SCORE = 0.5
#: Words remembered per worker, so that memory stays bounded.
CACHE = 200_000
#: Parts of a language whose smallest hashes are found apart.
PARTS = 64
#: Most languages whose thresholds are broadcast.
BROADCAST_LANGUAGES = 10_000
_BREAK = r"[^\p{L}\p{M}]+"
_POINT = streams(11, MAX_GRAM)


def letters(column: pa.Array) -> pa.Array:
    """Texts lower-cased and composed, everything but letters and marks turned into spaces; null where there is no letter."""
    low = pc.utf8_lower(column)
    low = pa.array([t and unicodedata.normalize("NFC", t) for t in low.to_pylist()], low.type)
    some = pc.match_substring_regex(low, r"\p{L}")
    return pc.if_else(some, pc.replace_substring_regex(low, _BREAK, " "), None)


def words_of(text: str | None) -> list[str]:
    """The words of one text."""
    cut = letters(pa.array([text], pa.string()))[0].as_py()
    return (cut or "").split()


def strings_at(column: pa.Array, words: Words, at: np.ndarray) -> list[str]:
    raw, _ = string_buffers(column)
    whole = raw.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]


def gram_keys(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of one size of every word between its marks, whether each lies in one word, and the word of each place."""
    marked = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(marked == 2) - 1
    points = marked.astype(U)
    total = np.full(len(points), U(size))
    ok = np.zeros(len(points), bool)
    n = max(len(points) - size + 1, 0)
    ok[:n] = word[:n] == word[size - 1 :]
    for k in range(size):
        total[:n] += mix(points[k : n + k] + U(k + 1)) * _POINT[k]
    return mix(total), ok, word


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n: the words of a task's texts, slice by slice."""
    for batch in bounded(batches, "text"):
        texts = letters(batch.column("text"))
        words = split_words(texts, BLANK)
        codes = batch.column("lang").dictionary_encode()
        lang = codes.indices.to_numpy(zero_copy_only=False)[words.doc].astype(U)
        _, index, n = np.unique(mix(words.hash ^ mix(lang + U(7))), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pc.take(batch.column("lang"), pa.array(words.doc[index])), pa.array(strings_at(texts, words, index), pa.string()), pa.array(n.astype(np.int64))],
            names=["lang", "word", "n"],
        )


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, size, key, n: size 0 for words, else the n-grams of that length in them; a row per batch, language and key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        codes = batch.column("lang").dictionary_encode()
        lang = codes.indices.to_numpy(zero_copy_only=False)
        own = split_words(pa.array(words, pa.string()), BLANK)
        parts = [(0, own.hash, np.arange(len(words)))]
        for size in range(1, MAX_GRAM + 1):
            keys, ok, word = gram_keys(words, size)
            parts.append((size, keys[ok], word[ok]))
        for size, keys, word in parts:
            order = np.lexsort((keys, lang[word]))
            keys, word = keys[order], word[order]
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (lang[word][1:] != lang[word][:-1])])) if len(keys) else np.zeros(0, np.int64)
            sums = np.add.reduceat(n[word], starts) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column("lang"), pa.array(word[starts])), pa.array(np.full(len(starts), size, np.int32)), pa.array(keys[starts].view(np.int64)), pa.array(sums)],
                names=["lang", "size", "key", "n"],
            )


class Model:
    """Log frequencies by size (0: words), key and language, as sorted keys with their languages and values."""

    def __init__(self, counts: pa.Table):
        names = counts.column("lang").to_pylist()
        self.langs = sorted(set(names))
        at = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.fromiter((at[x] for x in names), np.int32, len(names))
        size, key, n = (counts.column(c).to_numpy() for c in ("size", "key", "n"))
        key = key.view(U) if len(key) else np.zeros(0, U)
        wide = max(len(self.langs), 1)
        total = np.zeros((MAX_GRAM + 1, wide))
        np.add.at(total, (size, lang), n)
        self.floor = np.log(0.5) - np.log(total + 1.0)
        self.default = int(np.argmax(total[0])) if self.langs else -1
        self.keys, self.first, self.lang, self.value = [], [], [], []
        for s in range(MAX_GRAM + 1):
            mine = np.flatnonzero(size == s)
            mine = mine[np.lexsort((lang[mine], key[mine]))]
            keys, first = np.unique(key[mine], return_index=True)
            self.keys.append(keys)
            self.first.append(np.append(first, len(mine)).astype(np.int64))
            self.lang.append(lang[mine])
            self.value.append((np.log(n[mine]) - np.log(total[s, lang[mine]] + 1.0) - self.floor[s, lang[mine]]).astype(np.float32))

    def find(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key in a table, -1 if it has none."""
        table = self.keys[size]
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def add_rows(self, out: np.ndarray, size: int, rows: np.ndarray, into: np.ndarray) -> None:
        """Add the log frequencies of table rows to out's rows into."""
        np.add.at(out, into, self.floor[size])
        first, n = self.first[size][rows], self.first[size][rows + 1] - self.first[size][rows]
        flat = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(into, n), self.lang[size][flat]), self.value[size][flat])

    def score_words(self, keys: np.ndarray, words) -> np.ndarray:
        """A row of log frequencies for each word, at most MOST_PER_WORD below its best; zeros if nothing covers it.

        words gives the strings of the words at some indices; only those of unknown words are asked for.
        """
        out = np.zeros((len(keys), max(len(self.langs), 1)))
        row = self.find(0, keys)
        known, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        self.add_rows(out, 0, row[known], known)
        if len(new):
            covered = None
            places = np.zeros(len(new))
            strings = words(new)
            for size in range(MAX_GRAM, 0, -1):
                grams, ok, word = gram_keys(strings, size)
                covered = np.zeros(len(grams), bool) if covered is None else covered
                live = np.flatnonzero(ok & ~covered)
                rows = self.find(size, grams[live])
                hit = rows >= 0
                live, rows = live[hit], rows[hit]
                covered[live] = True
                self.add_rows(out, size, rows, new[word[live]])
                places += np.bincount(word[live], minlength=len(new))
            some = places > 0
            out[new[some]] /= places[some, None]
        return np.maximum(out, out.max(axis=1, keepdims=True) - MOST_PER_WORD)

    def predict(self, texts: pa.Array, memo: Memo) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        cut = letters(texts)
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.langs:
            return names.tolist(), scores
        words = split_words(cut, BLANK)
        keys, index, again = np.unique(words.hash, return_index=True, return_inverse=True)
        rows = memo.rows_of(self, keys, lambda at: strings_at(cut, words, index[at]))[again]
        some = words.counts > 0
        total = np.stack([np.bincount(words.doc, rows[:, k], words.n_docs) for k in range(len(self.langs))], axis=1)
        best = np.where(total.any(axis=1), total.argmax(axis=1), self.default)
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(words.counts, 1))[:, None])
        own = odds[np.arange(len(best)), best] / odds.sum(axis=1)
        names[some], scores[some] = np.array(self.langs, object)[best[some]], own[some]
        return names.tolist(), scores


class Memo:
    """Scores of words met so far, forgotten when there are more than CACHE."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.rows = np.zeros((0, 0))

    def rows_of(self, model: Model, keys: np.ndarray, words) -> np.ndarray:
        if not len(keys):
            return np.zeros((0, max(len(model.langs), 1)))
        if len(self.at) > CACHE:
            self.at, self.rows = {}, np.zeros((0, 0))
        names = keys.tolist()
        at = np.fromiter((self.at.get(k, -1) for k in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            scored, start = model.score_words(keys[new], lambda some: words(new[some])), len(self.at)
            if len(self.rows) < start + len(new):
                grown = np.zeros((2 * (start + len(new)), scored.shape[1]))
                if start:
                    grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(new)] = scored
            at[new] = np.arange(start, start + len(new))
            self.at.update((names[i], int(j)) for i, j in zip(new.tolist(), at[new].tolist(), strict=True))
        return self.rows[at]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the sample rows of smallest hash of each language of labelled (doc_id, text, lang)."""
    rows = labelled.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("by"))
    # Each task hands on the sample smallest hashes of a language and part of it at most, and each part the
    # same, so a language that most rows have is no burden, however many tasks there are.
    least = rows.select("lang", "by", F.pmod("by", F.lit(PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        least = least.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("by"))).where(F.col("k") <= sample)
    upto = scratch(least.groupBy("lang").agg(F.max("by").alias("upto")), "thresholds")
    chosen = rows.join(small_side(upto, BROADCAST_LANGUAGES), "lang").where("by <= upto").dropDuplicates(["lang", "by"])
    words = chosen.select("lang", "text").mapInArrow(_tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_items, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))
    model = Model(counts.toArrow())
    discard(upto)
    return model


def _identified(held):
    """(slice of a batch, languages, scores) for the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        model, memo = held.value, Memo()
        for batch in bounded(batches, "text"):
            yield batch, *model.predict(batch.column("text"), memo)

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text)."""
    found = _identified(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores in found(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """Pipeline stage: documents stay whose predicted language is wanted (any learned one by default) with min_score or more.

    The model learns from the labels of docs. Without a labelled row there is no language to predict, and
    every document with a letter stays. lang and all other columns stay as they came.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = _identified(spark.sparkContext.broadcast(model))
    wanted, columns = None if languages is None else set(languages), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, scores in found(pa.RecordBatch.from_arrays(b.columns, names=columns) for b in batches):
            kept = [name != UNKNOWN and (wanted is None or name in wanted) and score >= min_score for name, score in zip(names, scores.tolist(), strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, docs.schema)  # names may hold dots


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4)).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
