"""The election view written back into the forms archives publish.

Inputs for the source and normaliser queries: drifting payloads, section rows
and ZIP members.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna.functions.text import canonical_municipality, slug


def dotted(number: Column) -> Column:
    """1234567 as 1.234.567."""
    return F.translate(F.format_number(number, 0), ",", ".")


def printed(number: Column) -> Column:
    """Italian thousands dots in even years, a zero decimal fraction in odd ones."""
    even = F.year("election_date") % 2 == 0
    return F.when(even, dotted(number)).otherwise(F.concat(number.cast("string"), F.lit(",00")))


def drifting_payload() -> Column:
    """Column names of one generation in even years, of another in odd ones."""
    even = F.year("election_date") % 2 == 0

    def name(old: str, new: str) -> Column:
        return F.when(even, F.lit(old)).otherwise(F.lit(new))

    is_list = F.col("result_type") == "list"
    referendum = F.col("category") == "referendum"
    none = F.array().cast("array<struct<key:string,value:string>>")

    def entry(key: Column, value: Column) -> Column:
        # Joined arrays are compiled; a filter with a lambda would have all entries interpreted.
        return F.when(value.isNotNull(), F.array(F.struct(key.alias("key"), value.alias("value")))).otherwise(none)

    entries = F.concat(
        entry(name("regione", "descrreg"), F.col("region")),
        entry(name("circoscrizione", "descrcirc"), F.col("constituency")),
        entry(name("provincia", "descprovincia"), F.col("province")),
        entry(name("comune", "desccomune"), F.col("municipality")),
        entry(name("nazione", "paese"), F.col("country")),
        entry(name("collegio", "colluninom"), F.col("college")),
        entry(F.lit("turno"), F.col("round").cast("string")),
        entry(name("num_referendum", "numquesito"), F.col("question_number")),
        entry(name("elettori", "elettoritot"), printed(F.col("electors"))),
        entry(name("votanti", "votantitot"), printed(F.col("voters"))),
        entry(name("votivalidi", "voti_validi"), printed(F.col("valid_votes"))),
        entry(name("skbianche", "schede_bianche"), F.col("blank_ballots").cast("string")),
        entry(name("lista", "descrlista"), F.when(is_list & ~referendum, F.col("subject"))),
        entry(name("voti_lista", "votilista"), F.when(is_list & ~referendum, printed(F.col("votes")))),
        entry(F.lit("cognome"), F.when(~is_list & ~referendum, F.substring_index("subject", "#", 1))),
        entry(F.lit("nome"), F.when(~is_list & ~referendum, F.substring_index("subject", "#", -1))),
        entry(F.lit("voti_candidato"), F.when(~is_list & ~referendum, printed(F.col("votes")))),
        entry(name("seggi_lista", "seggilista"), F.col("seats").cast("string")),
        entry(F.lit("votivalidi_si"), F.when(referendum, printed(F.col("votes")))),
    )
    return F.map_from_entries(entries)


def raw_rows(er: DataFrame, *, sections: bool = False) -> DataFrame:
    """Raw rows of the normaliser from the election view."""
    payload = drifting_payload()
    if sections:
        payload = F.map_concat(
            payload, F.create_map(F.lit("sezione"), F.col("section").cast("string"))
        )
    # A keyed view has the canonical label and its key, made once a supplier.
    if "canonical" in er.columns:
        canonical, key = F.col("canonical"), F.col("municipality_key")
    else:
        canonical = canonical_municipality(F.col("municipality"))
        key = slug(canonical)
    return er.select(
        F.concat_ws("-", "category", F.year("election_date").cast("string")).alias("archive"),
        "category", "election_date",
        # Members in the order of their names.
        (
            F.substring("source_file", 1, 1).cast("int") * 100 + F.ascii(F.substring("source_file", -1, 1))
        ).alias("member_index"),
        F.col("source_file").alias("file_name"),
        F.col("source_row").alias("row_number"),
        "region", "constituency", "province",
        canonical.alias("municipality"),
        key.alias("municipality_key"),
        payload.alias("payload"),
        F.create_map().cast("map<string,double>").alias("numbers"),
    )


# ZIP archives --------------------------------------------------------------

ARCHIVE_FIELDS = (
    "category", "election_date", "region", "constituency", "province", "municipality", "college",
    "round", "electors", "voters", "subject", "votes", "source_row",
)
_HEADERS = (
    "CATEGORIA", "DATAELEZIONE", "REGIONE", "CIRCOSCRIZIONE", "PROVINCIA", "COMUNE", "COLLEGIO",
    "TURNO", "ELETTORI", "VOTANTI", "LISTA", "VOTI LISTA", "RIGA",
)


def _column_letters(index: int) -> str:
    return chr(ord("A") + index)


def _sheet_xml(records: list[tuple]) -> str:
    """A worksheet with a header, inline text and numeric cells."""
    lines = []
    for r, record in enumerate([_HEADERS, *records], start=1):
        cells = []
        for i, value in enumerate(record):
            if value == "":
                continue
            ref = f"{_column_letters(i)}{r}"
            if r > 1 and str(value).isdigit() and len(str(value)) < 15:
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
            else:
                text = str(value).replace("&", "&amp;").replace("<", "&lt;")
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    return (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        f'<sheetData>{"".join(lines)}</sheetData></worksheet>'
    )


def workbook_bytes(records: list[tuple], title: str = "Dati") -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
            f'<sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="worksheet"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", _sheet_xml(records))
    return stream.getvalue()


def archive_files(er: DataFrame) -> DataFrame:
    """ZIP files (path, content), each from one bounded Arrow batch of rows.

    Thirds of a batch become a delimited member, a spreadsheet and a member of
    polling sections that a reader of municipality files must drop.  One path
    per batch tries to leave its folder and must be rejected.
    """
    rows = er.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ARCHIVE_FIELDS]
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = list(batch.itertuples(index=False, name=None))
            book = [r for r in records if int(r[-1]) % 3 == 0]
            text = [r for r in records if int(r[-1]) % 3 == 1]
            polling = [r for r in records if int(r[-1]) % 3 == 2]
            stream = io.BytesIO()
            with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as target:
                for member, part in (("voti_comune.txt", text), ("voti_LivSez.txt", polling)):
                    lines = [";".join(r) for r in [_HEADERS, *part]]
                    target.writestr(f"dati/{member}", ("\n".join(lines) + "\n").encode("cp1252"))
                target.writestr("dati/voti.xlsx", workbook_bytes(book))
            unsafe = io.BytesIO()
            with zipfile.ZipFile(unsafe, "w") as target:
                target.writestr("../fuori.txt", "A;B\n1;2\n")
            name = f"{records[0][-1]}-{len(records)}" if records else "empty"
            yield pd.DataFrame(
                {
                    "path": [f"archivio-{name}.zip", f"esterno-{name}.zip"],
                    "content": [stream.getvalue(), unsafe.getvalue()],
                }
            )

    return rows.mapInPandas(pack, "path string, content binary")


def encoded_files(rows: DataFrame) -> DataFrame:
    """ZIP files (path, content) of ``rows`` (key), a member for each encoding and headerless layout of old archives."""

    def members(keys: list[int]) -> Iterator[tuple[str, str, str]]:
        head = "COMUNE;LISTA;VOTI LISTA"
        own = lambda kind: [k for k in keys if k % 5 == kind]
        for kind, name, place, encoding in (
            (0, "utf8/voti.csv", "Forlì", "utf-8-sig"), (1, "ansi/voti.csv", "Cantù €", "cp1252"), (2, "latino/voti.csv", "Gaetà\x81", "latin-1"),
        ):
            yield name, encoding, "\n".join([head, *[f"{place} {k};Più {k};{k * 3}" for k in own(kind)]])
        # No header: the number of columns and the name of the file tell the layout.
        yield "referendum/dati.csv", "cp1252", "\n".join(f"LAZIO;ROMA;Cantù {k};1;Sì o no {k};9;4;8;3;{k * 3};7;1" for k in own(3))
        yield "comunali/dati.csv", "cp1252", "\n".join(f"LAZIO;ROMA;Cantù {k};9;8;1;Più {k};{k * 3};2;ROSSI;ADA;;;;;5" for k in own(4))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stream = io.BytesIO()
            with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as target:
                for name, encoding, text in members(batch["key"].tolist()):
                    target.writestr(name, (text + "\n").encode(encoding))
            yield pd.DataFrame({"path": [f"codifiche-{batch['key'].iloc[0]}.zip"], "content": [stream.getvalue()]})

    return rows.select("key").mapInPandas(pack, "path string, content binary")
