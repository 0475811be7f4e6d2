import gzip
import hashlib

import pytest

from etlvault.llm.warc import WarcError, gzip_member, members, page_record, read_archives, read_records, write_archives


def test_members_are_gzip_files():
    a, b = page_record(1, "http://x", b"hello", None), page_record(2, None, b"", 1)
    assert gzip.decompress(a + b).count(b"WARC/1.1") == 2
    for size in (1, 7, 1 << 16):
        raw = a + b
        got = list(read_records(raw[i:i + size] for i in range(0, len(raw), size)))
        assert [r.headers["WARC-Type"] for r in got] == ["response", "revisit"] and got[0].block == b"hello"


def test_payload_may_look_like_a_record():
    block = b"WARC/1.1\r\nContent-Length: 3\r\n\r\n\x1f\x8b\x00\r\n\r\n" * 50
    assert [r.block for r in read_records(page_record(1, "", block, None))] == [block]


def test_broken_archives():
    good = page_record(1, "u", b"x" * 500, None)
    for bad in (good[:-5], good[:40] + b"\0" + good[41:], gzip_member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:AA")], b"x"), gzip.compress(b"no record")):
        with pytest.raises(WarcError):
            list(read_records(bad))
    assert list(members(b"")) == []


def test_round_trip(spark):
    big = "é" * 600
    data = [(1, "u", big, 0), (4, "u", big, 0), (3, None, big, 0), (5, "v\n w", "é" * 499, 0), (6, "v", "é" * 499, 0), (7, "", None, 0), (8, "", "", 0),
            (None, "n", big, 0), (9, "z", "y" * 300_000, 0), (9, "z", "y" * 300_000, 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, sha int")
    got = sorted(map(tuple, read_archives(write_archives(pages)).drop("url").collect()), key=str)
    want = []
    for i, _, html, _ in data:
        p = (html or "").encode()
        ref = 4 if html == big and i != 4 else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if ref else "response", ref))
    assert got == sorted(want, key=str)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(pages)).count() == 0
