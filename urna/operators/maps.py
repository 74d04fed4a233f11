"""Time-versioned district maps: which map and which laws apply to an election."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna import reference_data


def with_map_version(elections: DataFrame, date_column: str = "election_date") -> DataFrame:
    """Add map id and source law ids; NULL and an empty list in uncovered years.

    Point-in-interval join with the constant 13-row dimension on the broadcast
    side.  The reference versions of one category never overlap, so the join
    adds no rows; a list position would break a tie.
    """
    versions = F.broadcast(
        reference_data.map_versions(elections.sparkSession).select(
            F.col("category").alias("map_category"),
            "start_year",
            "end_year",
            F.col("id").alias("map_id"),
            F.col("source_ids").alias("map_source_ids"),
        )
    )
    year = F.year(date_column)
    joined = elections.join(
        versions,
        (elections["category"] == versions["map_category"])
        & (year >= versions["start_year"])
        & (year <= versions["end_year"]),
        "left",
    )
    return joined.drop("map_category", "start_year", "end_year").withColumn(
        "map_source_ids", F.coalesce("map_source_ids", F.array().cast("array<string>"))
    )


def map_sources(versions: DataFrame, laws: DataFrame) -> DataFrame:
    """Citations and addresses of each map version's laws, in the listed order."""
    exploded = versions.select(
        "position", "id", "category", "start_year", "end_year", "geography_level",
        F.posexplode("source_ids").alias("place", "source_id"),
    )
    cited = exploded.join(
        F.broadcast(laws.select(F.col("id").alias("source_id"), "citation", "source_url")),
        "source_id",
    )
    in_order = F.sort_array(
        F.collect_list(F.struct("place", "source_id", "citation", "source_url"))
    )
    return (
        cited.groupBy(
            "position", "id", "category", "start_year", "end_year", "geography_level"
        )
        .agg(in_order.alias("s"))
        .select(
            "position", "id", "category", "start_year", "end_year", "geography_level",
            F.col("s.source_id").alias("source_ids"),
            F.col("s.citation").alias("source_citations"),
            F.col("s.source_url").alias("source_urls"),
        )
    )


def list_maps(
    versions: DataFrame, *, category: str | None = None, year: int | None = None
) -> DataFrame:
    out = versions
    if category is not None:
        out = out.where(F.col("category") == category)
    if year is not None:
        out = out.where((F.col("start_year") <= year) & (F.col("end_year") >= year))
    return out.orderBy("position")
