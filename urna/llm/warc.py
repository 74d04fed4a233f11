"""WARC archives: a writer with revisit records and a splittable reader.

Writing: pages with equal payloads are grouped by their digest, the one with the
largest page_id is the response and the others revisit it. Every task streams its
records, each a gzip member of its own, into one archive under a name of its own
attempt, and reports it; archives of lost attempts are reported by nobody and so
never read.

Reading: archives are cut into byte ranges, one task each. A task looks for the
gzip magic, takes a place as a member only if what it inflates to starts with a
whole WARC header, and owns the records that start inside its range; the last one
is read past the range's end. No index and no hand-over between tasks is needed,
and a record's payload is checked against its digest.

Defined cases: a null html is an empty payload; a null url is an empty target;
equal rows are all written, rows that share the largest page_id all as responses;
a null page_id refers to the largest other one, or is a response; payloads below
``least`` bytes are all responses; no pages give no records; extra columns are
ignored. A payload of any length is streamed whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import file_system, stage

#: Bytes of a range.
SPLIT = 16 << 20
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a member that are inflated to judge it, at first.
PROBE = 4096
#: Tasks that read ranges, at most; each takes its share of them.
READERS = 20_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(text) -> str:
    """A header value: no line ends inside."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def _record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record; a revisit has the response's headers but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least: int = 0, level: int = 4) -> DataFrame:
    """Archives of all pages in ``folder``; returns the written table (path, length, records)."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", F.unhex(F.sha1(raw)).alias("digest"), F.octet_length(raw).alias("length"))
    original = stage(known.where(F.col("length") >= least).groupBy("digest").agg(F.max("page_id").alias("original")))
    ready = known.join(original, "digest", "left").select(
        F.col("page_id").cast("string").alias("page"), "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original").cast("string")).alias("refers_to"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records = length = 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for frame in frames:
                for page, url, html, other in zip(frame["page"], frame["url"], frame["html"], frame["refers_to"], strict=True):
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    payload = html.encode() if isinstance(html, str) else b""
                    page, url, other = (x if isinstance(x, str) else None for x in (page, url, other))
                    member = squeeze.compress(_record(page, url, payload, other)) + squeeze.flush()
                    out.write(member)
                    records, length = records + 1, length + len(member)
        yield pd.DataFrame({"path": [f"{folder}/{name}"], "length": [length], "records": [records]})

    return stage(ready.mapInPandas(run, "path string, length bigint, records bigint"))


class _Range:
    """Buffered reading from a place on, beyond the range's end if a member asks for it."""

    def __init__(self, source, start: int, length: int, end: int):
        self.source, self.base, self.length = source, start, length
        source.seek(start)
        # Two bytes more: a magic may start on the range's last byte.
        self.data = source.read(min(end + 2, length) - start)

    def more(self) -> bool:
        got = self.source.read(1 << 20)
        self.data += got
        return bool(got)

    def drop(self, place: int) -> None:
        """Forget what lies before a place."""
        self.data, self.base = self.data[place - self.base :], place


def _member(window: _Range, place: int):
    """(header, body, next place) of the member at a place, or None if there is none."""
    inflate = zlib.decompressobj(31)
    at, out = place - window.base, bytearray()
    sized = PROBE
    try:
        while not inflate.eof:
            piece = window.data[at : at + sized]
            if not piece and not window.more():
                return None  # cut short: not a member
            out += inflate.decompress(piece)
            at += len(piece)
            if out[:5] != b"WARC/"[: len(out[:5])]:
                return None
            sized = 1 << 18
    except zlib.error:
        return None
    at -= len(inflate.unused_data)
    head, mark, body = bytes(out).partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(body) < int(size):
        return None
    return fields, body[: int(size)], window.base + at


def records_in(source, start: int, end: int, length: int) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of the records that start in [start, end)."""
    window, place = _Range(source, start, length, end), start
    while place < end:
        found = window.data.find(MAGIC, place - window.base)
        if found < 0 or window.base + found >= end:
            return
        place = window.base + found
        member = _member(window, place)
        if member is None:
            place += 1
            continue
        yield member[0], member[1]
        place = member[2]
        if place < end and place - window.base > 1 << 22:
            window.drop(place)


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records of the archives (path, length): page_id, url, record_type, payload size and digest, refers_to, payload.

    Raises if a payload does not have the digest its header states.
    """
    ranges = archives.select(
        "path", "length",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("start"),
    )
    # A number, or adaptive execution would put these few small rows into one task.
    ranges = ranges.repartition(max(1, min(READERS, ranges.count())), "path", "start")
    number = re.compile(r"<urn:page:(-?\d*)>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, length, start in zip(frame["path"], frame["length"], frame["start"], strict=True):
                files, own = file_system(path)
                rows, held = [], 0
                with files.open_input_file(own) as source:
                    for head, block in records_in(source, start, min(start + split, length), length):
                        kind = head.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            size = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{path}: a payload at or after byte {start} is not what its digest says")
                        else:
                            size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                        page, refers = number.match(head["warc-record-id"])[1], head.get("warc-refers-to")
                        rows.append((page or None, head.get("warc-target-uri", ""), kind, size, digest, refers and number.match(refers)[1], payload if payloads and kind == "response" else None))
                        held += len(payload)
                        if held > 1 << 24:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers", "payload"]
    read_ = ranges.mapInPandas(run, "page string, url string, record_type string, payload_bytes bigint, payload_digest string, refers string, payload binary")
    return read_.select(
        F.col("page").cast("bigint").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast("bigint").alias("refers_to"), "payload",
    )
