"""Output shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Dates, flags and lists as text, integers as bigint."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.BooleanType)):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def sql_ppm(part: str, whole: str) -> str:
    """Half-up parts per million in integer arithmetic, NULL where whole is not positive."""
    return (
        f"CASE WHEN {whole} > 0 THEN CAST((2000000*({part})+({whole})) // (2*({whole})) AS BIGINT) END"
    )
