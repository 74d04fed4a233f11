"""Latest-wins merges, as aggregates that combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the given order."""
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row"))
        .select(*keys, "row.*")
        .select(*rows.columns)
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest stored page per address; the higher id decides at equal times."""
    return latest(snapshots, ["source_url"], ["retrieved_at", "id"])


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stored rows with the incoming ones put over them."""
    tagged = stored.withColumn("_newer", F.lit(0)).unionByName(incoming.withColumn("_newer", F.lit(1)))
    return latest(tagged, keys, ["_newer", *order]).drop("_newer")
