"""Data-set manifests: what a restore must reproduce.

A row's digest is defined on values, not on an engine's memory, so that another
engine can check it; digests of rows are added up, so those of partitions add up to
the table's and a check reads only partitions that changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of a hexadecimal digest that are kept of a row: 60 bits.
_DIGITS = 15


def _number(value: Column) -> Column:
    """A floating number as two integers: its 20 binary places, and 53 places beyond."""
    scaled = value.cast("double") * float(1 << 20)
    whole = F.floor(scaled)
    exact = F.concat_ws("/", whole.cast("string"), F.floor((scaled - whole) * float(1 << 53)).cast("string"))
    # What has no such places, or too many digits, as the engine writes it.
    return F.when(F.isnan(value) | (F.abs(value) >= float(1 << 42)), value.cast("string")).otherwise(exact)


def _text(value: Column, kind: T.DataType) -> Column:
    """A value as text that tells it from any other of its type."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        out = _number(value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.DateType):
        out = F.date_format(value, "yyyy-MM-dd")
    elif isinstance(kind, T.ArrayType):
        out = F.array_join(F.transform(value, lambda x: _text(x, kind.elementType)), ",")
    elif isinstance(kind, T.MapType):
        # Maps have no order of their own.
        pairs = F.transform(F.map_entries(value), lambda e: F.concat_ws("=", _text(e["key"], kind.keyType), _text(e["value"], kind.valueType)))
        out = F.array_join(F.array_sort(pairs), ",")
    elif isinstance(kind, T.StructType):
        out = F.concat_ws(",", *[_text(value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, T.BinaryType):
        out = F.lower(F.hex(value))
    else:
        out = value.cast("string")
    # Its length goes first, so that no two rows run together.
    return F.when(value.isNull(), "~").otherwise(F.concat(F.char_length(out).cast("string"), F.lit(":"), out))


def row_digest(df: DataFrame) -> Column:
    """60 bits of the MD5 of a row's values in the order of their columns."""
    row = F.concat_ws(";", *[_text(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return F.conv(F.substring(F.md5(row), 1, _DIGITS), 16, 10).cast("bigint")


def _figures(digest: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col(digest).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor(digest), F.lit(0)).alias("digest_xor"),
    ]


def partition_manifest(name: str, df: DataFrame, *by: str) -> DataFrame:
    """Rows and digest of every partition of a table (by the given columns), in one pass.

    ``partition`` holds its values as text; null is ``~``.
    """
    values = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in by]) if by else F.lit("")
    return df.select(values.alias("partition"), row_digest(df).alias("digest")).groupBy("partition").agg(*_figures("digest")).select(
        F.lit(name).alias("table"), "partition", "rows", "digest_sum", "digest_xor"
    )


def refreshed(known: DataFrame, changed: DataFrame, partitions: DataFrame) -> DataFrame:
    """A partition manifest after a change: ``partitions`` (table, partition) are replaced by those of ``changed``.

    ``changed`` is the manifest of the changed partitions alone; no other is read.
    """
    return known.join(partitions.select("table", "partition").distinct(), ["table", "partition"], "left_anti").unionByName(changed)


def added_up(partitions: DataFrame) -> DataFrame:
    """Rows and digest of every table, from its partitions."""
    return partitions.groupBy("table").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("digest_sum").cast("decimal(38,0)")).cast("string").alias("digest_sum"),
        F.bit_xor("digest_xor").alias("digest_xor"),
    )


def table_manifest(name: str, df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of one table, in one pass."""
    return df.select(row_digest(df).alias("digest")).agg(*_figures("digest")).select(F.lit(name).alias("table"), "rows", "digest_sum", "digest_xor")


def manifest(tables: dict[str, DataFrame], ledger: DataFrame | None = None) -> DataFrame:
    """All tables; with a ledger also the number of runs by status, as ``runs:<status>``."""
    parts = [table_manifest(n, t) for n, t in tables.items()]
    if ledger is not None:
        none = [F.lit("0").alias("digest_sum"), F.lit(0).cast("bigint").alias("digest_xor")]
        parts.append(run_counts(ledger).select(F.concat(F.lit("runs:"), "status").alias("table"), F.col("runs").alias("rows"), *none))
    return reduce(DataFrame.unionByName, parts)


def run_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def verify_manifest(written: DataFrame, found: DataFrame) -> DataFrame:
    """Table by table: same, different, missing or unexpected, with the figures found."""
    a = written.select("table", F.struct("rows", "digest_sum", "digest_xor").alias("w"))
    b = found.select("table", F.struct("rows", "digest_sum", "digest_xor").alias("f"))
    return a.join(b, "table", "full_outer").select(
        "table",
        F.when(F.col("f").isNull(), "missing")
        .when(F.col("w").isNull(), "unexpected")
        .when(F.col("w") == F.col("f"), "same")
        .otherwise("different")
        .alias("outcome"),
        "f.*",
    )
