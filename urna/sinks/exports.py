"""Semicolon CSV exports with a UTF-8 byte-order mark."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urna import fixed_values as fv
from urna.operators.facts import RESULT_ORDER, ordered, result_rows
from urna.session import in_compiled_methods, leaving_no_shuffles

_BOM = "﻿"


def _number_text(column: str, kind: T.DataType):
    c = F.col(column)
    return c.cast("string") if not isinstance(kind, T.DateType) else F.date_format(c, "yyyy-MM-dd")


def export_lines(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The export as one text column, quoted only where a field needs it."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def field(column: str):
        text = F.coalesce(_number_text(column, kinds[column]), F.lit(""))
        if isinstance(kinds[column], (T.NumericType, T.DateType)):
            return text
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        marked = [text.contains(mark) for mark in (";", '"', "\r", "\n")]
        return F.when(marked[0] | marked[1] | marked[2] | marked[3], quoted).otherwise(text)

    return rows.select(F.concat_ws(";", *[field(c) for c in columns]).alias("line"))


def header_line(columns: tuple[str, ...], renamed: dict[str, str] | None = None) -> str:
    return _BOM + ";".join((renamed or {}).get(c, c).upper() for c in columns)


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...] = (), renamed: dict[str, str] | None = None) -> None:
    """Write an export, in total order if one is given.

    A range sort keeps the files in sequence; each carries the header.
    """
    sorted_rows = ordered(rows, order) if order else rows
    names = [(renamed or {}).get(c, c).upper() for c in columns]
    names[0] = _BOM + names[0]
    out = sorted_rows.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    (
        out.write.mode("overwrite")
        .option("sep", ";").option("header", True).option("lineSep", "\n")
        .option("escape", '"').option("emptyValue", "").option("nullValue", "")
        .csv(path)
    )


def write_export(
    rows: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...], renamed: dict[str, str] | None = None,
    *, shaped: Callable[[DataFrame], DataFrame] | None = None, packed: bool = False,
) -> list[str]:
    """Write an ordered export of any size whose files, joined end to end, are one CSV file.

    ``path`` gets a file with mark and header, range-sorted parts without either, and
    ``ORDER``, the names in the order in which they belong together; these are
    returned. The last file to appear is ``ORDER``: without it an export is not done.
    ``shaped``: makes ``columns`` of each row by itself, after the sort, so that only
    what they are made of is shuffled. ``packed``: header and parts are gzip files,
    which joined end to end are one gzip file of the same CSV file.
    """
    spark = rows.sparkSession
    sorted_rows = ordered(rows, order)
    lines = export_lines(shaped(sorted_rows) if shaped else sorted_rows, columns)
    with leaving_no_shuffles(spark), in_compiled_methods(spark):
        lines.write.text(f"{path}/parts", lineSep="\n", compression="gzip" if packed else "none")
    java = spark._jvm.org.apache.hadoop.fs
    files = java.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(name: str, content: bytes) -> None:
        out = files.create(java.Path(f"{path}/{name}"), False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    header, head = "HEADER", (header_line(columns, renamed) + "\n").encode("utf-8")
    if packed:
        header, head = "HEADER.gz", gzip.compress(head)
    put(header, head)
    # As many names as the sort had tasks; a part's name begins with its task's number.
    found = sorted(x.getPath().getName() for x in files.listStatus(java.Path(f"{path}/parts")))
    names = [header, *[f"parts/{n}" for n in found if n.startswith("part-")]]
    put("ORDER", ("\n".join(names) + "\n").encode("utf-8"))
    return names


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a finished export with the number of its file in ``ORDER``."""
    order = spark.read.text(f"{path}/ORDER")
    listed = order.select(F.substring_index("value", "/", -1).alias("name"), F.monotonically_increasing_id().alias("file"))
    header = order.where(F.col("value").startswith("HEADER")).first()["value"]
    texts = spark.read.text([f"{path}/{header}", f"{path}/parts"])
    lines = texts.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("line"))
    # One name a file: as short as the list of the sort's tasks.
    return lines.join(F.broadcast(listed), "name").select("file", "line")


COVERAGE_SORT = (
    "data", "tipo_elezione", "regione", "provincia", "comune", "circoscrizione", "collegio",
    "fonte_file", "turno", "numero_quesito",
)
MUNICIPAL_SORT = ("data", "regione", "provincia", "comune", "partito", "candidato", "fonte_riga")
COVERAGE_NAMES = {"file_count": "fonte_file_count"}


def write_results(rows: DataFrame, path: str) -> list[str]:
    """The full history export: 36 columns in their order, one file after the other, packed.

    ``rows``: facts with their archives, as :func:`with_archive` gives them.
    """
    return write_export(rows, path, fv.RESULT_COLUMNS, RESULT_ORDER, shaped=result_rows, packed=True)


def payload_lines(rows: DataFrame) -> DataFrame:
    """Rows with maps and lists as JSON lines, keys of a map in order; nulls are left out."""
    columns = []
    for field in rows.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.MapType):
            c = F.map_from_entries(F.array_sort(F.map_entries(c)))
        columns.append(c.alias(field.name))
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def write_coverage(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, fv.COVERAGE_COLUMNS, COVERAGE_SORT, COVERAGE_NAMES)


def write_municipal(rows: DataFrame, path: str, *, detailed: bool = False) -> None:
    columns = fv.MUNICIPAL_COLUMNS if detailed else fv.MUNICIPAL_COMPACT_COLUMNS
    write_csv(rows, path, columns, MUNICIPAL_SORT)
