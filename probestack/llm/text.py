"""Vectorised text kernels over Arrow string columns: words, 64-bit word hashes, bounded slices."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def streams(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit constants of a seed."""
    base = U((seed * 0xD1B54A32D192ED03 + 1) % 2**64)
    return mix(base + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


_BYTE = streams(1, 256)
_STEP = U(0x5851F42D4C957F2D)
_STEP_INV = U(pow(0x5851F42D4C957F2D, -1, 2**64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        ups, downs = np.full(size, _STEP), np.full(size, _STEP_INV)
        ups[0] = downs[0] = U(1)
        _powers[:] = [np.cumprod(ups), np.cumprod(downs)]
    return _powers[0], _powers[1]


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _alnum_table() -> np.ndarray:
    """Lower-cased bytes; 0 for what `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` leaves out once A-Z are lowered."""
    table = _lower()
    for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[a : b + 1] = 0
    return table


def _blank_table() -> np.ndarray:
    """Lower-cased bytes; 0 for space and \\x09-\\x0D. NUL is a word byte, kept apart as 255 (never in UTF-8)."""
    table = _lower()
    table[0] = 255
    table[32] = 0
    table[9:14] = 0
    return table


ALNUM = _alnum_table()
BLANK = _blank_table()


class Words(NamedTuple):
    n_docs: int
    counts: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word, and the number of words
    doc: np.ndarray  # text of each word
    hash: np.ndarray  # 64 bits of each word
    starts: np.ndarray  # byte of each word in the slice
    ends: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most limit bytes of column, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def split_words(column: pa.Array, table: np.ndarray) -> Words:
    """Words of each text as runs of bytes that table maps to other than 0, with a hash of the mapped bytes."""
    raw, offsets = string_buffers(column)
    n_docs, n = len(offsets) - 1, len(raw)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(n_docs, np.zeros(n_docs, np.int64), np.zeros(n_docs + 1, np.int64), zero, np.zeros(0, U), zero, zero)
    low = table[raw]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = low != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    hashes, at = np.empty(len(starts), U), 0
    while at < len(starts):  # in blocks, so that a very long text takes little more room than a short one
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
        head = starts[at]
        block = low[head : ends[end - 1]]
        up, down = _power_tables(len(block) + 1)
        prefix = np.zeros(len(block) + 1, U)
        np.cumsum(_BYTE[block] * up[: len(block)], out=prefix[1:])
        hashes[at:end] = mix((prefix[ends[at:end] - head] - prefix[starts[at:end] - head]) * down[starts[at:end] - head])
        at = end
    return Words(n_docs, counts, first, np.repeat(np.arange(n_docs), counts), hashes, starts, ends)


_GRAM = streams(2, 64)


def gram_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words within each text, and the text of each, in order.

    A text with 1 to width - 1 words has one run: all its words.
    """
    n = len(words.hash)
    span = np.minimum(words.counts, width)
    runs = np.where(words.counts > 0, words.counts - span + 1, 0)
    doc = np.repeat(np.arange(words.n_docs), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + words.first[:-1][doc]
    total = np.zeros(len(doc), U)
    short = span[doc]
    for k in range(width):
        live = short > k
        if live.all():
            total += words.hash[at + k] * _GRAM[k]
        else:
            total += np.where(live, words.hash[np.minimum(at + k, max(n - 1, 0))], U(k + 1)) * _GRAM[k]
    return mix(total), doc
