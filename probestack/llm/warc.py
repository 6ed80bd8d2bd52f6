"""WARC archives: a writer with revisit records and a salvage reader.

Writer. Each page becomes a WARC/1.1 record in its own gzip member. Of records with equal payloads of
at least `least` bytes, that with the largest page_id is a response and the others are revisits that
refer to it; smaller payloads are all responses. Archives are rolled at ROLL_BYTES, written under a
temporary name and renamed; names hold the task's attempt, and the table of paths lists those of the
attempts that were committed, so a task that runs again or twice never touches another's files.

Reader. It streams an archive in blocks, checks each member (gzip, version line, length, digests) and
on a failed check searches for the next place from which a valid member or version line can be read,
recovers the records after it and reports the bytes skipped as a quarantined gap. Plain and
compressed archives, and mixtures of both, are read. A member may hold any number of records: its
content is streamed, and a damaged or truncated one gives the records before the damage. A gap within
a sound member has the member's offset and counts bytes of its content. Memory is bounded by a few
records and blocks.

Defined cases: a null html is an empty payload; a null page_id is read back as null and, among equal
payloads, counts as smaller than any number; rows that repeat both page_id and payload come out as
often as they came in, alike; any text may stand in a url (it is percent-encoded where a header line
needs it); an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probestack.llm.shared import read_table, scratch, scratch_path

ROLL_BYTES = 32 << 20
#: Archives are dealt to that many tasks at most when they are read.
READ_TASKS = 20_000
BLOCK = 1 << 16
#: The first block of a member, doubled up to BLOCK: a false mark costs little.
FIRST_BLOCK = 256
CRLF = b"\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Schemes of the engine's file systems that pyarrow.fs knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _store(path: str):
    """The file system of a path that is not mounted, and the path in it."""
    from pyarrow import fs

    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def open_file(path: str, mode: str) -> BinaryIO:
    """Open a path of the shared folder: by the file system where it is mounted, by pyarrow.fs elsewhere."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    store, inner = _store(path)
    return store.open_output_stream(inner) if mode == "wb" else store.open_input_stream(inner)


def rename(old: str, new: str) -> None:
    if old.startswith("file:") or "://" not in old:
        strip = lambda p: "/" + p[5:].lstrip("/") if p.startswith("file:") else p
        os.replace(strip(old), strip(new))
        return
    store, inner = _store(old)
    store.move(inner, _store(new)[1])


def record_bytes(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record, not compressed. A revisit keeps the full payload's digest and length in its headers."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{kind}')}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {urllib.parse.quote(url or '', safe='%:/?#[]@!$&()*+,;=~.-_')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: text/html; charset=utf-8",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + CRLF + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


class _Broken(Exception):
    pass


class _Window:
    """Bytes of a stream from a moving start; asks for more as they are needed."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.data, self.at, self.done = stream, bytearray(), 0, False

    def need(self, n: int) -> bool:
        while len(self.data) < n and not self.done:
            more = self.stream.read(max(BLOCK, n - len(self.data)))
            self.done = not more
            self.data += more
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _parse(window: _Window, most: int) -> tuple[dict[str, str], bytes, int]:
    """A plain record at the window's start: headers, block and length; _Broken if it isn't one."""
    window.need(9)
    if not bytes(window.data[:9]).startswith((b"WARC/1.0\r", b"WARC/1.1\r")):
        raise _Broken("no version line")
    seen = 0
    while (end := window.data.find(CRLF + CRLF, max(0, seen - 3))) < 0:
        seen = len(window.data)
        if seen > most:
            raise _Broken("headers too long")
        if not window.need(seen + BLOCK) and len(window.data) == seen:
            raise _Broken("headers don't end")
    headers = {}
    for line in bytes(window.data[:end]).split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Broken("header without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise _Broken("no length") from None
    if not 0 <= length <= most:
        raise _Broken("length out of bounds")
    whole = end + 4 + length + 4
    if not window.need(whole):
        raise _Broken("cut short")
    if window.data[whole - 4 : whole] != CRLF + CRLF:
        raise _Broken("no end after the block")
    block = bytes(window.data[end + 4 : whole - 4])
    named = headers.get("warc-block-digest", "")
    if named.startswith("sha1:") and named[5:] != digest_of(block):
        raise _Broken("digest differs")
    return headers, block, whole


class _Cut(_Broken):
    """The member itself can't be read on."""


class _Member:
    """The content of the gzip member at a window's start, as a stream."""

    def __init__(self, window: _Window):
        self.window, self.unpack, self.at, self.last, self.bad, self.step = window, zlib.decompressobj(31), 0, 0, "", FIRST_BLOCK

    def read(self, n: int) -> bytes:
        while not self.unpack.eof:
            if self.bad or not self.window.need(self.at + 1):
                raise _Cut(self.bad or "cut short")
            chunk, before = bytes(self.window.data[self.at : self.at + self.step]), self.unpack.copy()
            self.last, self.step = self.at, min(2 * self.step, BLOCK)
            self.at += len(chunk)
            try:
                out = self.unpack.decompress(chunk)
            except zlib.error as bad:
                self.bad, out = f"gzip: {str(bad)[:60]}", bytearray()
                with contextlib.suppress(zlib.error):  # what comes before the damage
                    for i in range(len(chunk)):
                        out += before.decompress(chunk[i : i + 1])
            if out:
                return bytes(out)
        return b""

    def forget(self) -> None:
        """Drop what lies before the last block read."""
        self.window.drop(self.last)
        self.at, self.last = self.at - self.last, 0

    def close(self) -> None:
        self.window.drop(self.at - len(self.unpack.unused_data))


def _member_records(window: _Window, most: int) -> Iterator[Record | Gap]:
    """Records of the member at the window's start and gaps between them; _Broken if it ends badly or has none.

    What was read is dropped as records come. A record is given once something comes after it, so that
    a member of one record with a wrong check sum stays a gap.
    """
    start, member = window.at, _Member(window)
    inner, held, gave, bad_from, reason = _Window(member), [], False, None, ""
    try:
        while inner.need(1):
            if held and bad_from is None:
                yield from held
                held, gave = [], True
                member.forget()
            try:
                headers, block, n = _parse(inner, most)
            except _Cut:
                raise
            except _Broken as broken:
                if bad_from is None:
                    bad_from, reason = inner.at, str(broken)
                inner.drop(_next_candidate(inner, 1, (b"WARC/1.",)))
                if member.at > most:
                    member.forget()
                continue
            if bad_from is not None:
                held.append(Gap(start, inner.at - bad_from, f"{reason}, at byte {bad_from} of a member's content"))
                bad_from = None
            held.append(Record(start, headers, block))
            inner.drop(n)
    except _Cut:
        if held and (gave or bad_from is not None or len(held) > 1):
            yield from held
            member.forget()
        raise
    if not held and not gave:
        raise _Broken(reason or "no record in the member")
    yield from held
    if bad_from is not None:
        yield Gap(start, inner.at - bad_from, f"{reason}, at byte {bad_from} of a member's content")
    member.close()


def _plain_record(window: _Window, most: int) -> Iterator[Record]:
    headers, block, length = _parse(window, most)
    yield Record(window.at, headers, block)
    window.drop(length)


def _next_candidate(window: _Window, start: int, marks: tuple[bytes, ...] = (b"\x1f\x8b\x08", b"WARC/1.")) -> int:
    """The next place from start on where a member or a version line may begin, or the end."""
    while True:
        places = [p for mark in marks if (p := window.data.find(mark, start)) >= 0]
        if places:
            return min(places)
        start = max(start, len(window.data) - 6)
        if not window.need(len(window.data) + BLOCK) and window.done:
            return len(window.data)


def salvage(stream: BinaryIO, most: int = 1 << 30) -> Iterator[Record | Gap]:
    """Records of an archive in order, and the gaps that could not be read.

    most bounds a record's headers, and the length that they may claim, so that damage cannot ask for all memory.
    """
    window = _Window(stream)
    bad_from, reason = None, ""
    while window.need(1):
        start = window.at
        try:
            packed = window.need(2) and window.data[:2] == b"\x1f\x8b"
            for found in (_member_records if packed else _plain_record)(window, most):
                if bad_from is not None:
                    yield Gap(bad_from, start - bad_from, reason)
                    bad_from = None
                yield found
        except _Broken as broken:
            if bad_from is None:
                bad_from, reason = window.at, str(broken)
            window.drop(_next_candidate(window, int(window.at == start)))
    if bad_from is not None:
        yield Gap(bad_from, window.at - bad_from, reason)


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name, part, out, size, temp, n = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, 0, "", 0

        def close() -> str:
            out.close()
            rename(temp, final := f"{name}-{part:04d}.warc.gz")
            return final

        for pdf in batches:
            for page_id, url, html, digest, kind, refers in pdf.itertuples(index=False, name=None):
                if out is None:
                    temp = f"{name}-{part:04d}.tmp"
                    out, size, n = open_file(temp, "wb"), 0, 0
                member = gzip_member(record_bytes(kind, None if pd.isna(page_id) else int(page_id), url, (html or "").encode("utf-8", "surrogatepass"), digest, None if pd.isna(refers) else int(refers)))
                out.write(member)
                size += len(member)
                n += 1
                if size >= roll:
                    yield pd.DataFrame({"path": [close()], "records": [n]})
                    out, part = None, part + 1
        if out is not None:
            yield pd.DataFrame({"path": [close()], "records": [n]})

    return run


READ_SCHEMA = "path string, offset long, length long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary"


def _reader(blocks: bool, whole_only: bool):
    def number(value: str | None):
        return int(value) if value is not None and value.lstrip("-").isdigit() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        ints = ("offset", "length", "page_id", "payload_bytes", "refers_to")

        def frame(rows: list[tuple]) -> pd.DataFrame:
            pdf = pd.DataFrame(rows, columns=names)
            return pdf.astype(dict.fromkeys(ints, "Int64"))

        for pdf in batches:
            for path, records in zip(pdf["path"], pdf["records"] if whole_only else [None] * len(pdf), strict=True):
                rows, held, n_read = [], 0, 0
                with open_file(path, "rb") as stream:
                    for x in salvage(stream):
                        n_read += 1
                        if isinstance(x, Gap):
                            if whole_only:
                                raise RuntimeError(f"{path}: unreadable at {x.offset} ({x.reason})")
                            rows.append((path, x.offset, x.length, x.reason, None, None, "gap", None, None, None, None))
                        else:
                            h = x.headers
                            # A response's payload is measured; a revisit has no payload here and names that of its headers.
                            whole = h.get("warc-type") == "response"
                            digest = digest_of(x.block) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:")
                            n = len(x.block) if whole else number(h.get("x-payload-length"))
                            rows.append((path, x.offset, None, None, number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-type"), n, digest, number(h.get("x-refers-to-page-id")), x.block if blocks else None))
                            held += len(x.block)
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if whole_only and n_read != records:
                    raise RuntimeError(f"{path}: {n_read} records read of {records} written")
                if rows:
                    yield frame(rows)

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; returns their paths and numbers of records.

    Payloads meet by digest in narrow rows (page_id, digest), pre-aggregated on the map side; only
    digests that occur twice go on to the pages, by a join that the engine may split where one
    payload is frequent. html itself is shuffled only if that table is too large to broadcast.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(F.encode(body, "UTF-8")).alias("sha1"), F.octet_length(body).alias("bytes"))
    twice = scratch(rows.where(F.col("bytes") >= least).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("best")).where("n > 1").select("sha1", "best"), "payloads")
    known = rows.join(twice, "sha1", "left")
    kind = F.when(F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best"))), "revisit").otherwise("response")
    known = known.withColumn("kind", kind).select("page_id", "url", "html", "sha1", "kind", F.when(F.col("kind") == "revisit", F.col("best")).alias("refers"))

    def with_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["sha1"] = [base64.b32encode(bytes.fromhex(x)).decode() for x in pdf["sha1"]]
            yield pdf

    write = _writer(folder, roll)
    return scratch(known.mapInPandas(lambda batches: write(with_digest(batches)), "path string, records long"), "archives")


def read_archives(paths: DataFrame, blocks: bool = True, whole_only: bool = False) -> DataFrame:
    """Records and gaps (record_type 'gap', with offset, length and reason) of the archives in paths (path).

    With whole_only, for archives just written (path, records), a gap or another number of records is an error.
    """
    n = min(max(paths.count(), 1), READ_TASKS)
    return paths.select("path", *["records"] * whole_only).repartition(n, "path").mapInPandas(_reader(blocks, whole_only), READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    found = read_archives(paths, blocks=False, whole_only=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0)
)
OP10_SQL = f"""
WITH hashed AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
best AS (SELECT h AS g, count(*) AS n, max(page_id) AS top FROM hashed GROUP BY h),
roles AS (SELECT *, n > 1 AND top IS NOT NULL AND (page_id IS NULL OR page_id < top) AS again FROM hashed JOIN best ON h = g)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to
FROM roles
"""
