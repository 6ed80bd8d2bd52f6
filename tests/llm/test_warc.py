import base64
import hashlib
import io
import random

import pytest

from probestack.llm.shared import scratch_path
from probestack.llm.warc import Gap, Record, digest_of, gzip_member, op10_warc, read_archives, record_bytes, salvage, write_archives


def members(n=6, plain=False):
    out = []
    for i in range(n):
        payload = f"<p>{i}</p>".encode() * (i * 50)
        r = record_bytes("response", i, f"http://x/{i}", payload, digest_of(payload))
        out.append(r if plain else gzip_member(r))
    return out


def read(data):
    found = list(salvage(io.BytesIO(data)))
    return [int(x.headers["x-page-id"]) for x in found if isinstance(x, Record)], [(x.offset, x.length) for x in found if isinstance(x, Gap)]


def test_whole_archives_and_mixtures():
    assert read(b"".join(members())) == (list(range(6)), [])
    assert read(b"".join(members(plain=True))) == (list(range(6)), [])
    a, b = members(), members(plain=True)
    assert read(a[0] + b[1] + a[2] + b[3]) == ([0, 1, 2, 3], [])
    assert read(gzip_member(b[0] + b[1]) + a[2]) == ([0, 1, 2], [])
    assert read(b"") == ([], [])


def test_damage_is_quarantined_and_later_records_recovered():
    for plain in (False, True):
        m = members(plain=plain)
        flipped = bytearray(m[2])
        flipped[-12 if not plain else -30] ^= 0xFF
        data = m[0] + m[1] + bytes(flipped) + m[3] + b"garbage WARC/1.x \x1f\x8b\x08 more" + m[4] + m[5][:-5]
        ids, gaps = read(data)
        assert ids == [0, 1, 3, 4]
        start = len(m[0]) + len(m[1])
        assert gaps[0] == (start, len(m[2])) and len(gaps) == 3
        assert gaps[1][1] == len(b"garbage WARC/1.x \x1f\x8b\x08 more") and gaps[2][0] + gaps[2][1] == len(data)


def test_random_damage_loses_no_untouched_record():
    rnd = random.Random(3)
    for _ in range(60):
        m = members(8, plain=rnd.random() < 0.5)
        starts = [sum(map(len, m[:i])) for i in range(9)]
        data = bytearray(b"".join(m))
        at = rnd.randrange(len(data))
        for k in range(at, min(len(data), at + rnd.randrange(1, 40))):
            data[k] = rnd.randrange(256)
            last = k
        hit = {i for i in range(8) if starts[i] <= last and at < starts[i + 1]}
        ids, gaps = read(bytes(data))
        assert set(range(8)) - hit <= set(ids)
        covered = sum(n for _, n in gaps) + sum(len(m[i]) for i in ids)
        assert covered == len(data)


def test_headers_that_claim_too_much():
    bad = members(plain=True)[1].replace(b"Content-Length: ", b"Content-Length: 99999999")
    ids, gaps = read(bad + members()[2])
    assert ids == [2] and len(gaps) == 1


def test_round_trip(spark):
    long = "ü<p>" * 200_000
    rows = [(1, "http://a b/ü\r\nX: 1", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (3, "u", None, "c"), (4, "u", "", "c"), (5, "u", long, "c"), (None, "u", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (7, "u", "<p>x</p>\n", "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    paths = write_archives(frame, scratch_path(spark, "t"), roll=1000)
    assert paths.count() >= 1
    got = read_archives(paths).collect()
    assert not [r for r in got if r.record_type == "gap"]
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, "revisit", 2, 8), (2, "response", 0, 8), (2, "response", 0, 8), (0, "revisit", 2, 8), (3, "revisit", 4, 0), (4, "response", 0, 0), (5, "response", 0, 5 * 200_000), (7, "response", 0, 9)]
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == sorted(want)
    assert {r.payload_digest for r in got if r.page_id in (1, 2)} == {b32("<p>x</p>")}
    assert bytes(next(r.block for r in got if r.page_id == 5)).decode() == long
    kinds = {(r.page_id or 0, r.record_type) for r in read_archives(write_archives(frame, scratch_path(spark, "t"), least=1)).collect()}
    assert (3, "response") in kinds and (1, "revisit") in kinds
    empty = write_archives(frame.limit(0), scratch_path(spark, "t"))
    assert empty.count() == 0 and read_archives(empty).collect() == []


def test_members_of_many_records():
    rnd = random.Random(5)
    plain = []
    for i in range(400):
        payload = rnd.randbytes(1000)
        plain.append(record_bytes("response", i, f"http://x/{i}", payload, digest_of(payload)))
    whole = gzip_member(b"".join(plain))
    after = gzip_member(record_bytes("response", 400, "u", b"", digest_of(b"")))
    # A member beyond the bound of one record.
    assert [int(x.headers["x-page-id"]) for x in salvage(io.BytesIO(gzip_member(b"".join(plain) * 8)), most=5000)] == list(range(400)) * 8
    # A bad record within a sound member.
    inner = [*plain]
    inner[7] = inner[7].replace(b"X-Payload", b"X-Pay\r\nload")
    ids, gaps = read(gzip_member(b"".join(inner)) + after)
    assert ids == [i for i in range(401) if i != 7] and gaps == [(0, len(inner[7]))]
    # A truncated and a damaged member give what comes before.
    ids, gaps = read(whole[: len(whole) // 2])
    assert ids == list(range(len(ids))) and len(ids) > 190 and len(gaps) == 1
    bad = bytearray(whole)
    bad[len(bad) // 2 : len(bad) // 2 + 200] = b"\xff" * 200
    ids, gaps = read(bytes(bad) + after)
    assert ids[:190] == list(range(190)) and ids[-1] == 400 and gaps and len(set(ids)) == len(ids)


def test_long_urls_and_archives_that_read_back_otherwise(spark, tmp_path):
    rows = [(1, "data:text/html," + "ü " * 400_000, "<p>x</p>"), (2, "u", "<p>y</p>"), (3, "u" * (3 << 20), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.payload_bytes) for r in op10_warc(spark, str(tmp_path)).collect()) == [(1, 8), (2, 8), (3, 0)]
    paths = write_archives(pages, scratch_path(spark, "t"))
    assert sum(r.records for r in paths.collect()) == 3
    with pytest.raises(Exception, match="records read of"):
        read_archives(paths.selectExpr("path", "records + 1 AS records"), whole_only=True).collect()
    (tmp_path / "bad.warc.gz").write_bytes(members()[1][:-9])
    bad = spark.createDataFrame([(str(tmp_path / "bad.warc.gz"), 1)], "path string, records long")
    with pytest.raises(Exception, match="unreadable at"):
        read_archives(bad, whole_only=True).collect()


def test_false_marks_cost_little():
    import time

    noise = b"\x1f\x8b\x08\x00" * 40_000
    began = time.time()
    m = members(3)
    ids, gaps = read(m[0] + noise + m[1] + m[2])
    assert ids == [0, 1, 2] and sum(n for _, n in gaps) == len(noise)
    assert time.time() - began < 20
