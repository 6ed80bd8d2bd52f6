"""License scans: fuzzy search for short notices.

A text is lower-cased (A-Z), cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` and joined by single
spaces. A notice of n characters may differ by n // EDIT_CHARS edits (substituted, inserted or dropped
characters). Split into one piece more than that, it keeps at least one piece intact in any such match
(pigeonhole), so the exact places of all pieces name all candidates; around them the regex library
matches the notice with its error bound, at word boundaries, and reports span and edits.

Base phrases are counted at every place where their words stand consecutively; fuzzy matches add
labels and spans. `score` is the best match's 1 - edits / length (1 for a base phrase, 0 for none).

Defined cases: a null or empty text has no words, no places, empty labels and score 0; rows are scanned
one by one, so repeated rows and null doc_ids come out as they came in; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import read_table
from probestack.llm.text import ALNUM

#: Phrases and labels that every scan has.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further short notices, found by the fuzzy search alone.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "spdx license identifier": "spdx",
}
#: One edit for so many characters; shorter notices match exactly.
EDIT_CHARS = 12
_BREAKS = bytes(32 if x == 0 else x for x in ALNUM.tolist())


class Span(NamedTuple):
    label: str
    notice: str
    start_word: int
    end_word: int  # exclusive
    edits: int


def joined_words(text: str | None) -> str:
    """The words of a text, lower-cased, with one space between them."""
    return b" ".join(x for x in (text or "").encode("utf-8", "replace").translate(_BREAKS).split(b" ") if x).decode("utf-8")


class Notice:
    def __init__(self, phrase: str, label: str, edit_chars: int = EDIT_CHARS):
        self.phrase, self.label, self.edits = phrase, label, len(phrase) // edit_chars
        cuts = [round(i * len(phrase) / (self.edits + 1)) for i in range(self.edits + 2)]
        self.pieces = [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        bound = f"{{e<={self.edits}}}" if self.edits else ""
        self.pattern = regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){bound}(?![^ ])")

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Merged stretches of text, from one word's beginning to another's end, that hold every match."""
        found = []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                found.append((max(0, at - offset - self.edits), at - offset + len(self.phrase) + self.edits))
                at = text.find(piece, at + 1)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                if b <= merged[-1][1]:
                    continue
                a = merged.pop()[0]
            else:
                a = text.rfind(" ", 0, a) + 1
            end = text.find(" ", b)
            merged.append((a, len(text) if end < 0 else end))
        return merged

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """start, end and edits of each verified match, in order."""
        for a, b in self.windows(text):
            for m in self.pattern.finditer(text, a, b):
                yield m.start(), m.end(), sum(m.fuzzy_counts)


class Words:
    """Counts words up to rising places of a text, reading it once."""

    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, 0

    def before(self, place: int) -> int:
        if place < self.at:
            self.at = self.n = 0
        self.n += self.text.count(" ", self.at, place)
        self.at = place
        return self.n


ALL = [Notice(p, x) for p, x in (BASE | NOTICES).items()]


def base_places(text: str, base: dict[str, str] = BASE) -> list[tuple[str, int]]:
    """label and first word of every place of a base phrase."""
    out, padded = [], f" {text} "
    for phrase, label in base.items():
        words, at = Words(text), padded.find(f" {phrase} ")
        while at >= 0:
            out.append((label, words.before(at)))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out, key=lambda x: x[1])


def fuzzy_spans(text: str, notices: list[Notice] = ALL) -> list[Span]:
    out = []
    for n in notices:
        words = Words(text)
        for a, b, edits in n.matches(text):
            first = words.before(a)
            out.append(Span(n.label, n.phrase, first, first + text.count(" ", a, b) + 1, edits))
    return out


SCHEMA = (
    "doc_id long, n_words long, places array<struct<label: string, word: long>>, "
    "spans array<struct<label: string, notice: string, start_word: long, end_word: long, edits: int>>"
)


def _scan(base: dict[str, str], notices: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_notices = [Notice(p, x) for p, x in (base | notices).items()]
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = joined_words(text)
                n = words.count(" ") + 1 if words else 0
                places = [{"label": x, "word": w} for x, w in base_places(words, base)]
                rows.append((None if pd.isna(doc_id) else int(doc_id), n, places, [x._asdict() for x in fuzzy_spans(words, all_notices)]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "places", "spans"])
            yield out.astype({"doc_id": "Int64", "n_words": "int64"})

    return run


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, places (of base phrases) and spans (of all notices, with edits) of each row of docs.

    base and notices map phrases, as their words joined by spaces, to labels.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan(base, notices), SCHEMA)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    words = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"]))))
    best = F.array_max(F.transform("spans", lambda s: 1.0 - s["edits"] / F.length(s["notice"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
