"""The published catalogue of archives, read from the page that lists it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.dates import parse_date
from urna.functions.urls import join_url


def read_catalogue(pages: DataFrame) -> DataFrame:
    """(url, html) to catalogue entries; all built-in expressions."""
    listing = F.regexp_extract("html", r"(?s)var\s+dataSet\s*=\s*(\[\[.*?\]\s*,?\s*\])\s*;", 1)
    entries = F.from_json(
        F.regexp_replace(listing, r",\s*\]", "]"), "array<array<string>>"
    )

    def cell(index: int):
        return F.nullif(F.trim(F.try_element_at("entry", F.lit(index))), F.lit(""))

    day = F.when(cell(5).rlike(r"^\d{2}/\d{2}/\d{4}$"), cell(5))
    return (
        pages.select(F.explode(entries).alias("entry"))
        .where(F.size("entry") >= 4)
        .select(
            cell(1).alias("category"),
            F.when(cell(2).rlike(r"^\d{4}$"), cell(2)).cast("int").alias("year"),
            cell(3).alias("relative_path"),
            cell(4).alias("filename"),
            parse_date(day).alias("election_date"),
            cell(7).alias("identifier"),
            join_url(fv.DOWNLOAD_BASE, cell(3)).alias("download_url"),
        )
    )


def select_entries(
    catalogue: DataFrame, *, category: str | None = None, year: int | None = None
) -> DataFrame:
    """Entries by category and year; undated ones come first."""
    out = catalogue
    if category:
        out = out.where(F.col("category") == category)
    if year:
        out = out.where(F.col("year") == year)
    return out.orderBy("category", F.col("election_date").asc_nulls_first(), "filename")


def import_candidates(
    catalogue: DataFrame,
    *,
    categories: list[str],
    start_year: int | None = None,
    end_year: int | None = None,
    imported: DataFrame | None = None,
) -> DataFrame:
    """Dated entries of a bulk import, without those already imported."""
    unknown = sorted(set(categories) - set(fv.CATEGORIES))
    if unknown:
        raise ValueError(f"unsupported election categories: {', '.join(unknown)}")
    if start_year is not None and end_year is not None and start_year > end_year:
        raise ValueError("start_year must not be after end_year")
    out = catalogue.where(F.col("category").isin(*categories) & F.col("election_date").isNotNull())
    if start_year is not None:
        out = out.where(F.year("election_date") >= start_year)
    if end_year is not None:
        out = out.where(F.year("election_date") <= end_year)
    if imported is not None:
        keys = ["category", "election_date", "filename"]
        out = out.join(imported.select(*keys).distinct(), keys, "left_anti")
    return out.orderBy("election_date", "category", "filename")


def ambiguous_elections(catalogue: DataFrame) -> DataFrame:
    """Elections for which the catalogue lists more than one archive."""
    return (
        catalogue.where(F.col("election_date").isNotNull())
        .groupBy("category", "election_date")
        .agg(F.count(F.lit(1)).alias("archives"))
        .where(F.col("archives") > 1)
    )


def already_normalised(catalogue: DataFrame, facts: DataFrame) -> DataFrame:
    """Catalogue entries that have result rows."""
    keys = ["category", "election_date"]
    return catalogue.join(facts.select(*keys), keys, "left_semi")
