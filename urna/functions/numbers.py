"""Numbers as Italian archives print them, and ratio columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urna.functions.text import clean_text, let

_DROPPED = r"[\s\x1c-\x1f\p{IsWhite_Space}.]+"


def parse_italian_int(value: Column) -> Column:
    """Dots are thousands separators; anything but a signed integer is NULL."""
    return let(
        F.regexp_replace(value, _DROPPED, ""),
        lambda digits: F.when(digits.rlike(r"^[-+]?[0-9]+$"), digits).try_cast("bigint"),
    )


def parse_italian_float(value: Column) -> Column:
    """Optional percent sign, decimal comma."""

    def read(text: Column) -> Column:
        decimal = F.translate(F.replace(text, F.lit(".")), ",", ".")
        return F.when(text.contains(","), decimal).otherwise(text).try_cast("double")

    return let(F.regexp_replace(clean_text(value), "[% ]", ""), read)


def as_int(text: Column, number: Column | None = None) -> Column:
    """Integer reading of a cell.

    ``number`` carries spreadsheet cells that were numbers: these count only if
    integral, while the text ``1234.5`` reads as 12345.
    """
    def read_digits(undotted: Column) -> Column:
        # With a decimal comma the fraction must be zero.
        return (
            F.when(undotted.rlike(r"^[-+]?[0-9]+(,0*)?$"), F.substring_index(undotted, ",", 1))
            .when(undotted.rlike(r"^[-+]?,0+$"), F.lit("0"))
            .try_cast("bigint")
        )

    read = let(F.regexp_replace(text, _DROPPED, ""), read_digits)
    if number is None:
        return read
    return F.when(number.isNull(), read).when(number == F.floor(number), number.try_cast("bigint"))


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Half-even rounded quotient, NULL on a zero or missing denominator."""
    return F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole at six digits, NULL where whole is zero or missing."""
    return F.bround(
        F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), 6
    )


def parts_per_million(part: Column, whole: Column) -> Column:
    """Half-up integer ratio in exact arithmetic, for engine-independent comparison."""
    doubled = F.nullif(whole * 2, F.lit(0).cast("bigint"))
    scaled = part * F.lit(2000000).cast("bigint") + whole
    return ((scaled - scaled % doubled) / doubled).cast("bigint")
