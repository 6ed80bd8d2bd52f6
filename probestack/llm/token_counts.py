"""Token counts that follow edits.

A text is cut into leaves at places where pre-tokenisation always begins anew, whatever stands further
off: before a single white-space character between two others, between a letter or digit and a
punctuation mark, between a letter and a digit, and between any mark but an apostrophe and a letter or
digit. No token crosses such a place. Leaves (of LEAF_CHARS characters or a little more, each a run of
whole pre-tokens) are the ends of a segment tree that sums characters and tokens. A run of letters
without such a place, like a Chinese clause, is one pre-token and one leaf.

An edit replaces a stretch of characters. The tree finds the leaves it touches; they and the leaf on
either side (the boundary context, as the edit may join or part pre-tokens there) are joined, edited,
encoded again and stored, and sums change along their paths to the root. Where they have grown by more
than SPLIT leaves' length, the text is dealt to more leaves and the tree's sums are made anew; no other
leaf is encoded for that. Everything else keeps its count. Counts equal those of encoding the edited text as a whole.

The vocabulary is a file of byte-pair ranks named by a parameter; the driver reads it and broadcasts
its bytes (at most MAX_VOCABULARY_BYTES). Strings of special tokens are ordinary text.

Defined cases: a null text is an empty one and has 0 tokens; null edits are none; an edit beyond the
text's end is cut to it, one with stop before start inserts at start; rows are treated one by one, so
repeated rows and null doc_ids come out as they came in; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
#: Fixed value: how the vocabulary's texts are cut into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 128
SPLIT = 4
_CUT = regex.compile(r"(?<=\S)(?=\s\S)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves_of(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Cut text at the first allowed place after each size characters."""
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


class TokenTree:
    """Segment tree over a text's leaves, with sums of characters and tokens."""

    def __init__(self, text: str, count, leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf_chars = count, leaf_chars
        leaves = leaves_of(text, leaf_chars) or [""]
        self._build(leaves, [count(x) for x in leaves])
        self.encoded = 0  # leaves encoded again since

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.size + tokens + pad
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last for the end), and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _store(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), self.count(text) if text else 0
        self.encoded += bool(text)

    def _neighbour(self, leaf: int, step: int) -> int | None:
        """The next leaf that way that isn't empty."""
        leaf += step
        while 0 <= leaf < len(self.leaves):
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters start to stop by text."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        first, before = self.find(start)
        last, _ = self.find(max(start, stop - 1))
        if (left := self._neighbour(first, -1)) is not None:
            before -= len(self.leaves[left])
            first = left
        if (right := self._neighbour(last, 1)) is not None:
            last = right
        whole = "".join(self.leaves[first : last + 1])
        whole = whole[: start - before] + text + whole[stop - before :]
        # The pieces fill the touched leaves; the last holds what is left over, unless that has grown too long.
        pieces = leaves_of(whole, self.leaf_chars)
        room = last - first + 1
        if sum(map(len, pieces[room - 1 :])) > SPLIT * self.leaf_chars and len(pieces) > room:
            tokens = self.tokens[self.size : self.size + len(self.leaves)]
            self.encoded += len(pieces)
            self._build(self.leaves[:first] + pieces + self.leaves[last + 1 :], tokens[:first] + [self.count(x) for x in pieces] + tokens[last + 1 :])
            return
        pieces = pieces[: room - 1] + ["".join(pieces[room - 1 :])]
        for i in range(room):
            self._store(first + i, pieces[i] if i < len(pieces) else "")
        nodes = {(x + self.size) >> 1 for x in range(first, last + 1)}
        while nodes and nodes != {0}:
            for node in nodes:
                self._sum(node)
            nodes = {x >> 1 for x in nodes if x > 1}

    def text(self) -> str:
        return "".join(self.leaves)


_encoders: dict[int, object] = {}


def _counter(vocabulary):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = vocabulary.value
        if hash(raw) not in _encoders:
            _encoders[hash(raw)] = encoder(raw)
        encode = _encoders[hash(raw)].encode_ordinary
        for pdf in batches:
            rows = []
            for doc_id, text, edits in zip(pdf["doc_id"], pdf["text"], pdf["edits"], strict=True):
                tree = TokenTree(text or "", lambda x: len(encode(x)))
                tokens, chars, leaves = tree.n_tokens, tree.n_chars, sum(map(bool, tree.leaves))
                edits = [] if edits is None else list(edits)
                for e in edits:
                    tree.edit(e["start"], e["stop"], e["text"] or "")
                rows.append((None if pd.isna(doc_id) else int(doc_id), chars, tokens, leaves, len(edits), tree.n_chars, tree.n_tokens, tree.encoded))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"} | dict.fromkeys(names[1:], "int64"))

    return run


SCHEMA = "doc_id long, n_chars long, n_tokens long, n_leaves long, n_edits long, n_chars_edited long, n_tokens_edited long, n_reencoded long"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of docs (doc_id, text, edits array<struct<start, stop, text>>) before and after the edits, in order."""
    with open(vocabulary, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is longer than {MAX_VOCABULARY_BYTES} bytes")
    held = docs.sparkSession.sparkContext.broadcast(raw)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits").mapInPandas(_counter(held), SCHEMA)


#: The edits that op7 makes in every document: an insertion, a deletion of up to 40 and a replacement of up to 5 characters.
EDITS = ((0, " and so on,"), (40, ""), (5, "Größe 42\n"))


def example_edits(doc_id, text):
    """An array of edits at places hashed from doc_id."""
    n = F.length(F.coalesce(text, F.lit("")))
    made = []
    for k, (width, new) in enumerate(EDITS):
        at = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(k)), (n + 1).cast("long")).cast("int")
        made.append(F.struct(at.alias("start"), (at + width).alias("stop"), F.lit(new).alias("text")))
    return F.array(*made)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after EDITS; documents bring no edits, so the query makes them up from doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs.select("doc_id", "text", example_edits(F.col("doc_id"), F.col("text")).alias("edits")))
