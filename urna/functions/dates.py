"""Date readings of published text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO, Italian and compact dates, tried in this order.
_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
)


def parse_date(value: Column) -> Column:
    text = F.trim(value)
    return F.coalesce(
        *[
            F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))).cast("date")
            for shape, fmt in _FORMATS
        ]
    )
