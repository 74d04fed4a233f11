import base64
import gzip
import hashlib
import io

import pytest

from urna.llm import queries, warc
from urna.llm.common import new_folder, read

PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "u r\r\nl", ""),
    (5, "http://c.example/é", "é" * 100_000), (6, "http://c.example/", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
    (2, "http://b.example/", "<p>one</p>"), (None, "http://n.example/", "<p>one</p>"), (None, "http://n.example/", "<p>alone</p>"),
]


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def _want(rows, least=0):
    largest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least and i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        first = largest.get(h or "")
        refers = first if first is not None and first != i else None
        out.append((i, len((h or "").encode()), _digest(h), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 3) for r in PAGES], "page_id bigint, url string, html string, digest string, length int")


@pytest.mark.parametrize("split", [64, 1000, 1 << 24])
@pytest.mark.parametrize("least", [0, 12])
def test_round_trip_at_any_split(spark, pages, split, least):
    done = warc.read(warc.write(pages, new_folder(spark, "warc"), least=least), split=split)
    assert _got(done) == _want(PAGES, least)
    payloads = {r.page_id: bytes(r.payload) for r in done.where("record_type = 'response' and page_id is not null").collect()}
    assert all(payloads[i] == (h or "").encode() for i, _, h in PAGES if i in payloads)


def test_archives_are_plain_gzip_members(spark, pages):
    for r in warc.write(pages.coalesce(1), new_folder(spark, "warc")).collect():
        path = r.path.removeprefix("file:")
        data = open(path, "rb").read()
        assert len(data) == r.length and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == r.records


def test_false_magic_is_no_record():
    member = gzip.compress(warc._record("7", "http://x/", b"text", None), mtime=0)
    data = b"\x1f\x8b\x08junk" + gzip.compress(b"not an archive") + member + b"\x1f\x8b\x08" + member + member[:-9]
    for split in (7, 50, 10_000):
        found = []
        for start in range(0, len(data), split):
            found += list(warc.records_in(io.BytesIO(data), start, min(start + split, len(data)), len(data)))
        assert len(found) == 2 and all(b.endswith(b"text") for _, b in found)


def test_no_pages(spark, pages):
    assert warc.read(warc.write(pages.limit(0), new_folder(spark, "warc"))).count() == 0


def test_whole_table(spark, small):
    rows = [tuple(r) for r in read(spark, small, "pages").select("page_id", "url", "html").collect()]
    assert _got(queries.op6_warc(spark, small)) == _want(rows)
