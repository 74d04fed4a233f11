"""Registry rows of colleges from the lines of scanned decrees.

A section of a decree is given the geography most of its entries belong to,
consecutive sections of one geography are numbered onward, zones are given the
city their prefix or code names or that the college's lines carry on, and names
are matched within their geography, all map versions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna.operators.colleges import (
    _prose,
    line_entries,
    majority_geography,
    match_names,
    merge_sections,
    zone_cities,
)
from urna.session import stage

#: The least similarity of a prefix to the split city it names, of a described city, and of a name.
PREFIX, DESCRIBED, NAME = 0.95, 0.6, 0.75
_COLLEGE = ("map_version", "section", "college")


def _place(geography: Column) -> Column:
    """A geography of one map version."""
    return F.concat_ws("\x1f", "map_version", geography)


def _entries(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Every entry of every college in printed order; ``found``: the lists and described cities of its text."""

    def exploded(column: str, order: int) -> DataFrame:
        return found.select(*_COLLEGE, "page", F.posexplode(column).alias("at", "e")).select(
            *_COLLEGE, "page", F.struct("college", F.lit(order).alias("part"), F.col("at").cast("bigint").alias("at")).alias("position"),
            "e.kind", "e.name", "e.raw",
        )

    none = F.lit(None).cast("string")
    listed = exploded("whole", 0).unionByName(exploded("described", 1))
    listed = listed.withColumns({"code": none, "prefix": none, "zone": none})
    printed = line_entries(lines, *_COLLEGE).withColumn(
        "position", F.struct("college", F.lit(2).alias("part"), F.col("line_no").cast("bigint").alias("at"))
    )
    return listed.unionByName(printed.select(listed.columns))


def _with_descriptions(entries: DataFrame, found: DataFrame, college: str = "college") -> DataFrame:
    """``description``: the whole text of its college for a described city, else empty.

    A text is as long as its college, so entries carry it only from here on.
    """
    key = lambda number: F.struct("map_version", "section", F.col(number).alias("college")).alias("_key")
    texts = found.where(F.size("described") > 0).select(key("college"), "prose")
    return entries.withColumn("_key", key(college)).join(texts, "_key", "left").withColumn(
        "description", F.when(F.col("kind") == "described_part", F.col("prose")).otherwise("")
    ).drop("_key", "prose")


def college_entries(lines: DataFrame) -> DataFrame:
    """Every entry of every college in printed order: lists in prose, described cities, lines."""
    found = stage(_prose(lines, *_COLLEGE))
    return _with_descriptions(_entries(lines, found), found)


def registry_rows(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """(map_version, geography, college, municipality, entry_type, entry_text, source_page, ocr_text, match_score).

    ``lines``: map_version, section, college (its number in the section), page,
    line_no, line. ``reference``: map_version, geography, name (canonical), college,
    as open data name them. A municipality below the accepted score is empty.
    """
    found = stage(_prose(lines, *_COLLEGE))
    entries = stage(_entries(lines, found))
    known = stage(reference.where(F.col("geography").isNotNull() & F.col("name").isNotNull()).select(
        "map_version", "geography", F.upper("name").alias("name"), F.coalesce("college", F.lit("")).alias("college")
    ).distinct())
    owners = known.select("map_version", "geography", "name").distinct()
    sections = majority_geography(entries.select("map_version", "section", "position", "name"), owners, "map_version")
    numbered = merge_sections(
        entries.groupBy("map_version", "section").agg(F.max("college").alias("last_college")).join(sections, ["map_version", "section"])
    ).select("map_version", "section", F.col("geography").alias("owner"), "offset")
    placed = stage(
        entries.join(numbered, ["map_version", "section"]).withColumn("geography", _place(F.col("owner"))).withColumn(
            "number", (F.col("college") + F.col("offset")).cast("bigint")
        )
    )
    names = known.select(_place(F.col("geography")).alias("geography"), "name", "college").distinct()
    splits = names.groupBy("geography", "name").agg(F.countDistinct("college").alias("n")).where(F.col("n") > 1).select("geography", "name")
    names = names.select("geography", "name").distinct()

    # One matching for all lists: a split city's name among split cities, any name among all.
    listed = lambda df, kind: df.withColumn("geography", F.concat(F.lit(f"{kind}\x1f"), "geography"))
    zone, part = F.col("kind") == "zone", F.col("kind") == "described_part"
    asked = listed(placed.where(zone).select("geography", F.col("prefix").alias("text")), "split").unionByName(
        listed(placed.where(part).select("geography", F.col("name").alias("text")), "split")
    ).unionByName(listed(placed.select("geography", F.col("name").alias("text")), "all"))
    every = listed(splits, "split").unionByName(listed(names, "all"))
    matches = stage(match_names(asked.where(F.col("text").isNotNull()).distinct(), every))

    def of(kind: str, text: str, found: str, score: str) -> DataFrame:
        own = matches.where(F.col("geography").startswith(f"{kind}\x1f"))
        return own.select(
            F.substring("geography", len(kind) + 2, 1 << 30).alias("geography"), F.col("text").alias(text),
            F.col("municipality").alias(found), F.coalesce("score", F.lit(0.0)).alias(score),
        )

    near = placed.join(of("split", "prefix", "near", "near_score"), ["geography", "prefix"], "left")
    near = near.withColumn("prefix_city", F.when(F.col("near_score") >= PREFIX, F.col("near")))
    # A college of a section is one of its geography: the section is part of the key.
    read = near.withColumn("own_college", F.col("college")).withColumn("college", F.struct("section", "college"))
    resolved = zone_cities(read, splits, names)
    named = (
        resolved.join(of("split", "name", "part_name", "part_score"), ["geography", "name"], "left")
        .join(of("all", "name", "any_name", "any_score"), ["geography", "name"], "left")
    )
    city = F.col("city").isNotNull()
    described = (F.col("kind") == "described_part") & F.col("part_name").isNotNull()
    score = (
        F.when(city, F.lit(1.0))
        .when(described, F.when(F.col("part_score") >= DESCRIBED, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.coalesce("any_score", F.lit(0.0)))
    )
    municipality = F.when(city, F.col("city")).when(described, F.col("part_name")).otherwise(F.col("any_name"))
    return _with_descriptions(named, found, "own_college").select(
        "map_version", F.col("owner").alias("geography"), F.col("number").alias("college"),
        F.when(score >= NAME, F.coalesce(municipality, F.lit(""))).otherwise("").alias("municipality"),
        F.col("kind").alias("entry_type"),
        F.when(F.col("kind") == "zone", F.coalesce("zone", F.lit(""))).otherwise(F.col("description")).alias("entry_text"),
        F.col("page").alias("source_page"), F.trim("raw").alias("ocr_text"), F.round(score, 3).alias("match_score"),
    )
