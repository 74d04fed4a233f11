"""ZIP archives of delimited text and spreadsheets as a table of raw rows.

Archives are listed first and their members spread over the cluster still
compressed; each member is then decoded as a stream, so one large archive does
not become one task.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import itertools
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.text import text_key
from urna.operators.normalise import with_raw_geography
from urna.session import stage

#: Longest content that one row can hold.
LONGEST_CONTENT = 2**31 - 1
_BATCH = 5000
_MEMBERS = "path string, member_index int, member string, method int, data binary, error string"
_ROWS = (
    "path string, member_index int, file_name string, row_number bigint, "
    "payload map<string,string>, numbers map<string,double>, error string"
)


# Members ---------------------------------------------------------------------


def _compressed(content: bytes, info: zipfile.ZipInfo) -> bytes:
    name_size, extra_size = struct.unpack_from("<HH", content, info.header_offset + 26)
    start = info.header_offset + 30 + name_size + extra_size
    return content[start : start + info.compress_size]


def _members(content: bytes, cap: int | None, municipality_level: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = archive.infolist()
        unpacked = 0
        for info in infos:
            path = info.filename.replace("\\", "/")
            if path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"unsafe path: {info.filename}")
            unpacked += info.file_size
            if cap is not None and unpacked > cap:
                raise ValueError("archive exceeds the maximum extracted size")
        kept = [
            (i, info)
            for i, info in enumerate(infos)
            if not info.is_dir()
            and posixpath.splitext(info.filename)[1].casefold() in (".txt", ".csv", ".xlsx")
            and not (
                municipality_level
                and any(m in text_key(info.filename) for m in fv.NOT_MUNICIPALITY_LEVEL)
            )
        ]
        if not kept:
            raise ValueError("no supported TXT, CSV or XLSX member")
        for i, info in kept:
            if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.flag_bits & 1:
                yield i, info.filename, info.compress_type, _compressed(content, info)
            else:
                yield i, info.filename, zipfile.ZIP_STORED, archive.read(info)


def list_members(
    files: DataFrame,
    *,
    max_uncompressed_bytes: int | None = None,
    municipality_level_only: bool = True,
) -> DataFrame:
    """(path, content) to one row per supported member, or one row with the error."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "member_index", "member", "method", "data", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                # A member at a time; one that fails ends its archive with an error row.
                found = _members(content, max_uncompressed_bytes, municipality_level_only)
                while True:
                    try:
                        member = next(found, None)
                        row = None if member is None else (path, *member, None)
                    except Exception as error:  # a bad archive must not end the job
                        member, row = None, (path, None, None, None, None, str(error))
                    if row is not None:
                        yield pd.DataFrame([row], columns=columns).astype({"member_index": "Int32", "method": "Int32"})
                    if member is None:
                        break

    return files.select("path", "content").mapInPandas(explode, _MEMBERS)


# Rows of one member --------------------------------------------------------------


def _encoding(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            raw.decode(encoding)
            return encoding
        except UnicodeDecodeError:
            continue
    return "latin-1"


def _headerless(file_name: str, count: int) -> tuple[str, ...] | None:
    key = text_key(file_name)
    for (kind, columns), names in fv.HEADERLESS.items():
        if kind in key and columns == count:
            return names
    return None


def delimited_rows(raw: bytes, file_name: str) -> Iterator[tuple[int, dict, dict]]:
    """Records of a delimited member as (row number, payload, numbers)."""
    stream = io.TextIOWrapper(io.BytesIO(raw), encoding=_encoding(raw), newline="\n")
    header = re.sub(r'"[^"]*"', "", stream.readline())
    stream.seek(0)
    # The header record decides: its most frequent separator, the semicolon where none occurs.
    reader = csv.reader(stream, delimiter=max(fv.DELIMITERS, key=header.count))
    first = next(reader, None)
    if not first:
        return
    headers = [text_key(cell) for cell in first]
    number = 2
    inferred = _headerless(file_name, len(first))
    if inferred and sum(h in fv.KNOWN_HEADERS for h in headers) < 2:
        yield 1, dict(zip(inferred, first)), {}
        headers = list(inferred)
    for number, values in enumerate(reader, start=number):
        payload = {h: v for h, v in zip(headers, values) if h}
        if payload:
            yield number, payload, {}


_XL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(_DATE_FORMATS)
    for fmt in root.iter(f"{_XL}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search("[dmyhs]", code, re.I):
            dated.add(int(fmt.get("numFmtId")))
    cells = root.find(f"{_XL}cellXfs")
    styles = cells if cells is not None else ()
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", 0)) in dated}


def _cell(cell, shared: list[str], dated: set[int]) -> tuple[str, float | None]:
    """Text and, for numbers, the value of a spreadsheet cell."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_XL}t")), None
    node = cell.find(f"{_XL}v")
    if node is None or node.text is None:
        return "", None
    text = node.text
    if kind == "s":
        return shared[int(text)], None
    if kind == "b":
        return str(text == "1"), float(text)
    if kind != "n":
        return text, None
    value = float(text)
    if int(cell.get("s", 0)) in dated:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=value)
        return moment.isoformat(), None
    return (repr(value) if re.search("[.eE]", text) else str(int(text))), value


def _column(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def workbook_rows(raw: bytes, file_name: str) -> Iterator[tuple[int, str, int, dict, dict]]:
    """Records as (sheet position, member#sheet, row number, payload, numbers)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_XL}t")))
        dated = _date_styles(book)
        targets = {
            r.get("Id"): r.get("Target")
            for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_XL}sheet")
        for place, sheet in enumerate(sheets):
            target = targets[sheet.get(f"{_REL}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            headers: dict[int, str] | None = None
            with book.open(path) as stream:
                number = 0
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_XL}row":
                        continue
                    number = int(row.get("r", number + 1))
                    cells = {}
                    for position, c in enumerate(row.iter(f"{_XL}c")):
                        where = _column(c.get("r")) if c.get("r") else position
                        cells[where] = _cell(c, shared, dated)
                    row.clear()
                    if headers is None:
                        keys = {i: text_key(t) for i, (t, _) in cells.items() if text_key(t)}
                        headers = keys if len(keys) >= 2 else None
                        continue
                    present = {h: cells.get(i, ("", None)) for i, h in headers.items()}
                    if any(text.strip() for text, _ in present.values()):
                        yield (
                            place,
                            f"{file_name}#{sheet.get('name')}",
                            number,
                            {h: text for h, (text, _) in present.items()},
                            {h: value for h, (_, value) in present.items() if value is not None},
                        )


def _rows_of(member: str, raw: bytes) -> Iterator[tuple]:
    if posixpath.splitext(member)[1].casefold() == ".xlsx":
        yield from workbook_rows(raw, member)
    else:
        for number, payload, numbers in delimited_rows(raw, member):
            yield 0, member, number, payload, numbers


def _cells(rows: list[dict | None], items: pa.DataType, read) -> pa.MapArray:
    """One map a row, from its dict; no dict is null."""
    ends = [0, *itertools.accumulate(len(row or ()) for row in rows)]
    keys = pa.array([key for row in rows if row for key in row], pa.string())
    values = pa.array([read(value) for row in rows if row for value in row.values()], items)
    missing = np.array([row is None for row in rows])
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(missing, False)), keys, values)


def _clean(text: str | None) -> str | None:
    """``clean_text`` of one cell: the same white space."""
    return None if text is None else " ".join(text.split())


def read_members(members: DataFrame) -> DataFrame:
    """Decode members to raw rows with clean cells; a member that fails yields one error row.

    The maps of a batch are built as columns: as objects each would be turned into pairs one by one.
    """

    def packed(held: list[tuple]) -> pa.RecordBatch:
        path, index, name, number, payload, numbers, error = map(list, zip(*held))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(path, pa.string()), pa.array(index, pa.int32()), pa.array(name, pa.string()),
                pa.array(number, pa.int64()), _cells(payload, pa.string(), _clean),
                _cells(numbers, pa.float64(), lambda value: value), pa.array(error, pa.string()),
            ],
            names=["path", "member_index", "file_name", "row_number", "payload", "numbers", "error"],
        )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, member, method, data in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                held: list[tuple] = []
                try:
                    raw = zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
                    for row in _rows_of(member, raw):
                        place, *rest = row
                        held.append((path, index * 1000 + place, *rest, None))
                        if len(held) == _BATCH:
                            yield packed(held)
                            held = []
                except Exception as error:
                    held.append((path, index * 1000, member, None, None, None, str(error)))
                if held:
                    yield packed(held)

    spread = members.where(F.col("error").isNull()).repartition("path", "member_index")
    return spread.select("path", "member_index", "member", "method", "data").mapInArrow(decode, _ROWS)


def read_archives(
    files: DataFrame,
    *,
    max_uncompressed_bytes: int | None = None,
    municipality_level_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Raw rows of the readable archives, and (path, error) of the others.

    An archive with any broken member counts as unreadable, so the decoded rows
    are staged before the rejects are known.
    """
    members = list_members(
        files,
        max_uncompressed_bytes=max_uncompressed_bytes,
        municipality_level_only=municipality_level_only,
    )
    decoded = stage(
        read_members(members).unionByName(
            members.where(F.col("error").isNotNull()).select("path", "error"),
            allowMissingColumns=True,
        )
    )
    rejects = decoded.where(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("error"))
    readable = decoded.where(F.col("error").isNull()).join(rejects.select("path"), "path", "left_anti")
    return with_raw_geography(readable.drop("error")), rejects


def load(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """ZIP files as (path, content, sha256), and (path, error) of files no row can hold.

    The length is known from the listing, so the content of those is never read.
    """
    files = spark.read.format("binaryFile").load(pattern)
    held = files.where(F.col("length") <= LONGEST_CONTENT).select("path", "content", F.sha2("content", 256).alias("sha256"))
    rejects = files.where(F.col("length") > LONGEST_CONTENT).select(
        "path", F.concat(F.lit("too long for one row: "), F.col("length").cast("string"), F.lit(" bytes")).alias("error")
    )
    return held, rejects


def with_election(rows: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add archive, category and election date, and (path, error) of the archives without them.

    The catalogue's relative path (``archive``) must be the end of the archive's
    path; without that column its file name stands in.  An archive that matches
    no dated entry, or entries of several elections, is a reject.
    """
    key = "archive" if "archive" in catalogue.columns else "filename"
    entries = catalogue.select(
        F.col(key).alias("archive"), F.substring_index(key, "/", -1).alias("file_"), "category", "election_date"
    ).distinct()
    paths = rows.select("path").distinct().withColumn("file_", F.substring_index("path", "/", -1))
    found = paths.join(entries, "file_", "left").withColumn(
        "fits_",
        F.col("archive").isNotNull()
        & ((F.col("path") == F.col("archive")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("archive")))),
    )
    fit = F.struct("archive", "category", "election_date")
    judged = found.groupBy("path").agg(
        F.count_if("fits_").alias("n_"), F.max(F.when(F.col("fits_"), fit)).alias("fit_")
    ).withColumn(
        "error",
        F.when(F.col("n_") == 0, "not in the catalogue")
        .when(F.col("n_") > 1, "several elections in the catalogue")
        .when(F.col("fit_.election_date").isNull(), "no election date in the catalogue"),
    )
    matched = judged.where(F.col("error").isNull()).select("path", "fit_.*")
    return rows.join(matched, "path"), judged.where(F.col("error").isNotNull()).select("path", "error")
