"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words `[^\\x20\\x09-\\x0D]+` (A-Z lowered), then one end. Unigrams and bigrams (with a start
before the first token) of the training texts are counted over the whole corpus. A count c is
quantised to level 1 + floor(log2 c); the filter holds the events (n-gram, 1) ... (n-gram, level), so a
query probes levels until one is missing and reads the count as the middle of the last level's range.
With those counts, P(w) = (c(w) + 1) / (N + V + 1) and P(w | v) = (c(v w) + PRIOR P(w)) / (c(v) + PRIOR);
`score` is the sum of log10 P(w | v). The filter is made of one segment per hash bucket, each filled by
the task that sums the bucket's counts; segments grow with their events, and no event is left out at
any size. The filter is never gathered: texts are put in chunks (written once, so that their numbers
stand), each chunk sends its distinct n-grams to the buckets, the task that has filled a bucket's
segment probes them there, and the levels go back to the chunk by its number.

`base_score` needs exact counts. Tokens that are frequent in a bounded sample are looked up in a small
broadcast table of their exact counts; the others meet their counts in a shuffle by token. The sample
only decides which way a token's count travels, so a frequent word never gathers in one task.

Defined cases: a null text is an empty one, which has one token, the end; a null doc_id is trained on
and not held out; rows that repeat count as often as they occur in training and are all scored; no
training rows give N = V = 0; other columns are ignored; an empty table gives an empty result. Words
are compared by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import held_out, read_table, scratch
from probestack.llm.text import BLANK, U, bounded, mix, split_words

PROBES = 6
#: Bits of an event: PROBES / ln 2.
EVENT_BITS = 8.66
PRIOR = 30.0
#: The bounded sample, and the most tokens that are called frequent after it.
SAMPLE = 20_000
FREQUENT = 100_000
#: Text per bucket of the counts; text that one task aggregates before it hands counts on.
BUCKET_BYTES = 8 << 20
GROUP_BYTES = 6 << 20
GROUP_ENTRIES = 200_000
#: Text of a chunk, whose distinct n-grams are probed together, and the most rows of one (a power of two).
CHUNK_BYTES = 2 << 20
ROW_BITS = 20
#: Chunks that one partition may have, as a power of two.
CHUNK_BITS = 23
END, START = U(0x0E4D0E4D0E4D0E4D), U(0x57A2757A2757A275)
_LEFT, _RIGHT = U(0x9E6C63D0876A9A47), U(0xC13FA9A902A6328F)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for later stages, which need it elsewhere."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Tokens(NamedTuple):
    token: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def tokens_of(column: pa.Array) -> Tokens:
    """Tokens of each text (words and an end) with the token before each (or the start)."""
    words = split_words(column, BLANK)
    counts = words.counts + 1
    ends = np.cumsum(counts) - 1
    token = np.full(int(counts.sum()), END)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = words.hash
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - words.counts] = START
    return Tokens(token, before, np.repeat(np.arange(words.n_docs), counts), counts)


def bigrams(tokens: Tokens) -> np.ndarray:
    return mix(tokens.before * _LEFT + tokens.token * _RIGHT)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)


def print_of(keys: np.ndarray) -> np.ndarray:
    """The 32 bits of a key that its bucket does not use."""
    return (keys >> U(32)).astype(np.uint32)


def _blobs(kind: int, buckets: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row per bucket: its entries, column after column, in one binary value."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edges))
    columns = [c[order] for c in columns]
    values = [b"".join(c[edges[b] : edges[b + 1]].tobytes() for c in columns) for b in some]
    n = np.diff(edges)[some]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(values, pa.binary())],
        names=["kind", "bucket", "n", "entries"],
    )


BLOB_SCHEMA = "kind int, bucket int, n int, entries binary"


def _entries(table: pa.Table, kind: int, *dtypes) -> list[np.ndarray]:
    """The columns of all blobs of a kind, joined."""
    out: list[list[np.ndarray]] = [[np.zeros(0, d)] for d in dtypes]
    for k, n, blob in zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("entries").to_pylist(), strict=True):
        if k == kind:
            at = 0
            for column, d in zip(out, dtypes, strict=True):
                column.append(np.frombuffer(blob, d, n, at))
                at += n * np.dtype(d).itemsize
    return [np.concatenate(c) for c in out]


def _count(buckets: int):
    """Training counts of a task's texts, as blobs: kind 0 unigrams (hash, count), 1 bigrams (32 bits, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos, size = [], [], 0

        def flush():
            keys, n = _summed(np.concatenate([k for k, _ in ones]), np.concatenate([c for _, c in ones]))
            yield _blobs(0, buckets, bucket_of(keys, buckets), keys, n.astype(np.int64))
            keys, n = _summed(np.concatenate([k for k, _ in twos]), np.concatenate([c for _, c in twos]))
            small = n < 255
            for part in (small, ~small):
                if part.any():
                    kind, wide = (1, np.uint8) if part is small else (2, np.int64)
                    yield _blobs(kind, buckets, bucket_of(keys[part], buckets), print_of(keys[part]), n[part].astype(wide))

        for batch in bounded(batches, "text"):
            tokens = tokens_of(batch.column("text"))
            ones.append(_summed(tokens.token))
            twos.append(_summed(bigrams(tokens)))
            size += len(tokens.token) * 6
            if size >= GROUP_BYTES:
                yield from flush()
                ones, twos, size = [], [], 0
        if ones:
            yield from flush()

    return run


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def middle_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    return np.where(levels > 0, (2.0 ** (levels - 1.0) + 2.0**levels - 1.0) / 2.0, 0.0)


_HALF = U(0xFFFFFFFF)
_BIT = np.left_shift(np.uint8(1), np.arange(8, dtype=np.uint8))


def _event(prints: np.ndarray, order: int, level: int) -> np.ndarray:
    return mix(prints.astype(U) | U(order << 40 | level << 48))


def _place(event: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The i-th bit of events in segments of so many bits (below 2^32), by double hashing of an event's halves."""
    return ((((event >> U(32)) + U(i) * (event | U(1))) & _HALF) * bits) >> U(32)


def segment(parts: list[tuple[int, np.ndarray, np.ndarray]], most_bits: float = math.inf) -> bytes:
    """Filter segment of (order, prints, levels): all events; a bound, which the operator never sets, leaves out the rarest levels beyond it."""
    least = 1
    while True:
        kept = [(o, p[q >= least], q[q >= least]) for o, p, q in parts]
        events = sum(int(q.sum()) for _, _, q in kept)
        if events * EVENT_BITS <= most_bits or not events:
            break
        least += 1
    bits = max(64, -(-int(events * EVENT_BITS) // 8) * 8)
    field = np.zeros(bits, bool)
    for order, prints, levels in kept:
        for level in range(1, int(levels.max(initial=0)) + 1):
            event = _event(prints[levels >= level], order, level)
            for i in range(PROBES):
                field[_place(event, i, U(bits))] = True
    return np.packbits(field, bitorder="little").tobytes()


CHUNK_SCHEMA = "chunk long, texts binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in chunks of about CHUNK_BYTES of text: a number and the rows as one compressed stream."""
    number = TaskContext.get().partitionId() << CHUNK_BITS
    held, size, rows = [], 0, 0

    def pack() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "texts"])

    for batch in bounded(batches, "text", CHUNK_BYTES):
        if rows + batch.num_rows > 1 << ROW_BITS:
            yield pack()
            held, size, rows, number = [], 0, 0, number + 1
        held.append(batch)
        rows += batch.num_rows
        size += int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
        if size >= CHUNK_BYTES:
            yield pack()
            held, size, rows, number = [], 0, 0, number + 1
    if held:
        yield pack()


def row_keys(chunk: int, rows: int) -> np.ndarray:
    """A number of its own for every row of every chunk."""
    return (chunk << ROW_BITS) + np.arange(rows, dtype=np.int64)


def _unpack(texts: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(texts).read_all().combine_chunks().to_batches()[0]


PROBE_SCHEMA = "chunk long, kind int, bucket int, n int, entries binary"


def _probes(buckets: int):
    """Distinct n-grams of each chunk, as blobs: kind 3 unigrams, 4 bigrams (32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                tokens = tokens_of(_unpack(texts.as_buffer()).column("text"))
                for kind, keys in ((3, _summed(tokens.token)[0]), (4, _summed(bigrams(tokens))[0])):
                    give_back()
                    blobs = _blobs(kind, buckets, bucket_of(keys, buckets), print_of(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(blobs.num_rows, chunk)), *blobs.columns], names=["chunk", *blobs.schema.names])

    return run


#: Per bucket a row without chunk, with the bucket's totals, and for each chunk and order of n-grams a row of levels.
FILLED_SCHEMA = "bucket int, chunk long, kind int, levels binary, tokens long, types long, hot binary"


def _fill(frequent, buckets: int):
    """Sum a bucket's counts, fill its segment and answer the probes that the chunks sent to it."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _summed(*_entries(table, 0, U, np.int64))
        prints, n = _entries(table, 1, np.uint32, np.uint8)
        more, wide = _entries(table, 2, np.uint32, np.int64)
        pairs, n = _summed(np.concatenate([prints, more]), np.concatenate([n.astype(np.int64), wide]))
        bits = segment([(1, print_of(keys), levels_of(counts)), (2, pairs, levels_of(n))])
        own = Model([{"bucket": bucket, "bits": bits, "tokens": 0, "types": 0, "hot": b""}], buckets, 0)
        hot = np.isin(keys, frequent.value, assume_unique=True)
        rows = [(bucket, None, None, None, int(counts.sum()), len(keys), keys[hot].tobytes() + counts[hot].tobytes())]
        for kind, order in ((3, 1), (4, 2)):
            probes = table.filter(pc.equal(table.column("kind"), kind))
            (prints,) = _entries(probes, kind, np.uint32)
            levels, at = own.levels(prints.astype(U) << U(32) | U(bucket), order).astype(np.uint8), 0
            for chunk, n in zip(probes.column("chunk").to_pylist(), probes.column("n").to_pylist(), strict=True):
                rows.append((bucket, chunk, kind, levels[at : at + n].tobytes(), None, None, None))
                at += n
        del table, own, keys, counts, prints, n, more, wide, pairs
        give_back()
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in FILLED_SCHEMA.split(", ")])

    return run


class Model:
    """Segments, exact counts of frequent tokens and the totals.

    The task of a bucket makes one with its segment to probe it; the one that is broadcast has no
    segments, so that its size is bounded by FREQUENT.
    """

    def __init__(self, rows: list, buckets: int, texts: int):
        self.buckets, self.texts = buckets, texts
        self.tokens, self.types = sum(r["tokens"] for r in rows), sum(r["types"] for r in rows)
        self.bits = np.full(buckets, 64, U)
        offset, parts, hot = np.zeros(buckets, U), [b"\0" * 8], []
        at = 8
        for r in rows:
            self.bits[r["bucket"]], offset[r["bucket"]] = len(r["bits"]) * 8, at * 8
            parts.append(bytes(r["bits"]))
            at += len(r["bits"])
            hot.append(np.frombuffer(r["hot"], U).reshape(2, -1))
        self.offset, self.field = offset, np.frombuffer(b"".join(parts), np.uint8)
        hot = np.concatenate(hot, axis=1) if hot else np.zeros((2, 0), U)
        order = np.argsort(hot[0])
        self.hot, self.hot_counts = hot[0][order], hot[1][order].astype(np.int64)
        self.whole = float(self.tokens + self.types + 1)

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Level of each key: probes go on while the filter has the next."""
        bucket, prints = bucket_of(keys, self.buckets), print_of(keys)
        bits, offset = self.bits[bucket], self.offset[bucket]
        out, live, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(live) and level < 64:
            event = _event(prints, order, level)
            # Most absent events fail at the first probe: the others are made for what is left.
            for probes in (range(1), range(1, 3), range(3, PROBES)):
                present = np.ones(len(live), bool)
                for i in probes:
                    place = (_place(event, i, bits) + offset).view(np.int64)
                    present &= (self.field.take(place >> 3) & _BIT.take(place & 7)) != 0
                live, event, bits, offset = live[present], event[present], bits[present], offset[present]
            prints = print_of(keys[live])
            out[live] = level
            level += 1
        return out

    def log_probabilities(self, tokens: Tokens, answers: pa.Table) -> np.ndarray:
        """log10 P(token | token before) of each token of a chunk, by the levels found for its n-grams."""
        kinds, inverse = np.unique(tokens.token, return_inverse=True)
        count = middle_of(_in_order(answers, 3, kinds, self.buckets))[inverse]
        first = tokens.before == START
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[first] = float(self.texts)
        # The words of a bigram that occurs do so as well: any other that was found is a false one.
        likely = (count >= 1) & (context >= 1)
        pairs, again = np.unique(bigrams(tokens), return_inverse=True)
        pair = np.where(likely, middle_of(_in_order(answers, 4, pairs, self.buckets))[again], 0.0)
        pair = np.minimum(pair, np.minimum(context, count))
        single = np.minimum((count + 1.0) / self.whole, 1.0)
        return np.log10((pair + PRIOR * single) / (context + PRIOR))

    def exact(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether the token is frequent) from the exact table."""
        if not len(self.hot):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.hot, tokens), len(self.hot) - 1)
        found = self.hot[at] == tokens
        return np.where(found, self.hot_counts[at], 0), found


def _in_order(answers: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Levels of a chunk's sorted distinct keys, from the answers of the buckets."""
    mine = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("bucket")
    found = np.frombuffer(b"".join(mine.column("levels").to_pylist()), np.uint8)
    if len(found) != len(keys):
        raise RuntimeError(f"{len(found)} levels for {len(keys)} n-grams")
    out = np.zeros(len(keys), np.int64)
    out[np.argsort(bucket_of(keys, buckets), kind="stable")] = found
    return out


def fit(training: DataFrame, chunks: DataFrame, frequent: np.ndarray, buckets: int) -> tuple[Model, DataFrame]:
    """The totals and exact counts of frequent tokens, and a table of the levels of the chunks' n-grams."""
    hot = training.sparkSession.sparkContext.broadcast(np.sort(frequent))
    counts = training.select("text").mapInArrow(_count(buckets), BLOB_SCHEMA).select(F.lit(None).cast("long").alias("chunk"), "*")
    probes = chunks.mapInArrow(_probes(buckets), PROBE_SCHEMA)
    filled = scratch(counts.unionAll(probes).groupBy("bucket").applyInArrow(_fill(hot, buckets), FILLED_SCHEMA), "levels")
    rows = filled.where("chunk is null").select("bucket", F.lit(b"").alias("bits"), "tokens", "types", "hot").collect()
    return Model(rows, buckets, training.count()), filled.where("chunk is not null").select("chunk", "bucket", "kind", "levels")


def frequent_tokens(docs: DataFrame, sample: int = SAMPLE, most: int = FREQUENT) -> np.ndarray:
    """Hashes of the tokens in most texts of a sample (rows of smallest hash), at least three of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            tokens = tokens_of(batch.column("text"))
            keys, n = _summed(_in_texts(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["token", "n"])

    by = F.xxhash64("doc_id", "text")
    lowest = docs.select(by.alias("by")).orderBy("by").limit(sample).agg(F.max("by"), F.count("*")).first()
    some = docs.where(by <= lowest[0]) if lowest[1] >= sample else docs
    counts = some.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 3")
    return counts.orderBy(F.desc("n"), "token").limit(most).toPandas()["token"].to_numpy(np.int64).view(U)


def _in_texts(tokens: Tokens) -> np.ndarray:
    """Each token once for each text that has it."""
    order = np.lexsort((tokens.token, tokens.doc))
    token, doc = tokens.token[order], tokens.doc[order]
    return token[np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])] if len(token) else token


def _score(model):
    """Per text of a chunk the model's score and the frequent tokens' part of base_score."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        m, batch = model.value, _unpack(chunk.column("texts")[0].as_buffer())
        tokens = tokens_of(batch.column("text"))
        starts = np.cumsum(tokens.counts) - tokens.counts
        count, hot = m.exact(tokens.token)
        columns = [
            tokens.counts.astype(np.int64),
            np.add.reduceat((count > 0).astype(np.int64), starts),
            np.add.reduceat(np.log10(count + 1.0) * hot, starts),
            np.add.reduceat(m.log_probabilities(tokens, answers), starts),
        ]
        give_back()
        return pa.table(
            [pa.array(row_keys(chunk.column("chunk")[0].as_py(), batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)],
            names=["key", "doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "score"],
        )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows of chunks, with the rows' numbers."""
    for chunks in batches:
        for chunk, texts in zip(chunks.column("chunk").to_pylist(), chunks.column("texts"), strict=True):
            whole, at = _unpack(texts.as_buffer()), 0
            keys = row_keys(chunk, whole.num_rows)
            for batch in bounded(iter([whole]), "text"):
                yield batch, keys[at : at + batch.num_rows]
                at += batch.num_rows


def _rare(model):
    """(token, text, count) of the tokens that are not frequent, as blobs; a held-out text's counts are negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size = model.value, [], 0

        def flush() -> pa.RecordBatch:
            token, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return _blobs(0, m.buckets, bucket_of(token, m.buckets), token, key, n)

        for batch, keys in _pieces(batches):
            tokens = tokens_of(batch.column("text"))
            rare = ~m.exact(tokens.token)[1]
            token, doc = tokens.token[rare], tokens.doc[rare]
            if not len(token):
                continue
            order = np.lexsort((token, doc))
            token, doc = token[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(starts, len(token)))
            token, doc = token[starts], doc[starts]
            n = np.where(batch.column("held_out").to_numpy(zero_copy_only=False)[doc], -n, n).astype(np.int32)
            held.append((token, keys[doc], n))
            size += len(token)
            if size >= GROUP_ENTRIES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _lookup(table: pa.Table) -> pa.Table:
    """Exact training counts of a bucket's tokens, brought to the texts that hold them."""
    token, key, n = _entries(table, 0, U, np.int64, np.int32)
    order = np.argsort(token)
    token, key, n = token[order], key[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.repeat(np.add.reduceat(np.maximum(n, 0), starts), np.diff(np.append(starts, len(token))))
    n = np.abs(n)
    order = np.argsort(key)
    key, n, count = key[order], n[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    add = lambda x: pa.array(np.add.reduceat(x, starts))
    return pa.table({"key": pa.array(key[starts]), "rare_known": add(n * (count > 0)), "rare_sum": add(n * np.log10(count + 1.0))})


def score_texts(docs: DataFrame) -> DataFrame:
    """Score docs (doc_id, text, held_out) with a model of those not held out; a row per row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "held_out")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    chunks = scratch(docs.select("doc_id", "held_out", "text").mapInArrow(_chunks, CHUNK_SCHEMA), "chunks")
    fitted, levels = fit(docs.where("not held_out"), chunks, frequent_tokens(docs), buckets)
    model = spark.sparkContext.broadcast(fitted)
    whole = fitted.whole
    near = chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_score(model), "key long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_sum double, score double")
    far = chunks.mapInArrow(_rare(model), BLOB_SCHEMA).groupBy("bucket").applyInArrow(_lookup, "key long, rare_known long, rare_sum double")
    far = far.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("rare_known", "rare_sum")])
    both = near.join(far, "key", "left")
    known = F.col("hot_known") + F.coalesce("rare_known", F.lit(0))
    base = F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(whole)))
    return both.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(fitted.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", "text", held_out("doc_id", 7).alias("held_out")))
