"""Split municipalities put together again: fragments, layers, best layer.

A *unit* is one published fragment (raw label, college, constituency) within a
file, result type and round; a *layer* sums the units of a municipality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna.functions.text import ascii_lower, canonical_municipality, place_key, slug

LAYER = ("archive", "category", "election_date", "source_file", "result_type", "round")
_UNIT = ("label", "college", "constituency")


def with_keys(facts: DataFrame) -> DataFrame:
    """Add ``canonical_key`` and ``place``, the keys of the canonical municipality.

    A fact table stores both; they are computed only where they are missing.
    """
    out = facts
    if "canonical_key" not in out.columns:
        out = out.withColumn("canonical_key", slug(canonical_municipality(F.col("municipality"))))
    if "place" not in out.columns:
        out = out.withColumn(
            "place",
            place_key(
                F.col("canonical_key"), F.col("province"), F.col("region"), F.col("constituency")
            ),
        )
    return out


def fragment_units(facts: DataFrame, *keys: str) -> DataFrame:
    """Published fragments: largest electors and voters, summed votes.

    ``facts`` needs the key columns (``place`` by default); the sums and maxima
    combine map-side, so a very large municipality shuffles one row per unit.
    """
    keys = keys or ("place",)
    return (
        facts.where(F.col("municipality").isNotNull())
        .withColumn("label", F.col("municipality"))
        .withColumn("college", F.coalesce("college", F.lit("")))
        .withColumn("constituency", F.coalesce("constituency", F.lit("")))
        .groupBy(*keys, *LAYER, *_UNIT)
        .agg(
            F.max("electors").alias("electors"),
            F.max("voters").alias("voters"),
            F.sum("votes").alias("votes"),
        )
    )


def geography_units(facts: DataFrame) -> DataFrame:
    """Units kept apart by province and region, ready to meet any request."""
    keyed = with_keys(facts)
    return (
        keyed.where(F.col("canonical_key").isNotNull())
        .withColumn("label", F.col("municipality"))
        .groupBy("canonical_key", "province", "region", *LAYER, *_UNIT)
        .agg(
            F.max("electors").alias("electors"),
            F.max("voters").alias("voters"),
            F.sum("votes").alias("votes"),
        )
    )


def scope_predicate() -> Column:
    """Request scope against a row: province, else region, or else constituency.

    A constituency widens a province or region; a request that names none of
    the three matches every homonym.
    """
    by_province = ascii_lower(F.col("province")) == ascii_lower(F.col("req_province"))
    by_region = ascii_lower(F.col("region")) == ascii_lower(F.col("req_region"))
    by_constituency = ascii_lower(F.col("constituency")) == ascii_lower(F.col("req_constituency"))
    unscoped = (
        F.col("req_province").isNull()
        & F.col("req_region").isNull()
        & F.col("req_constituency").isNull()
    )
    main = F.when(F.col("req_province").isNotNull(), by_province).when(
        F.col("req_region").isNotNull(), by_region
    )
    return unscoped | F.coalesce(main, F.lit(False)) | F.coalesce(by_constituency, F.lit(False))


def requested_units(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Units of each request (place, municipality, province, region, constituency).

    An equi-join on the municipality key, on election too if the requests name
    one; the scope is a residual condition.  Units are regrouped because one
    request may span several provinces or regions.
    """
    asked = requests.select(
        "place",
        slug(canonical_municipality(F.col("municipality"))).alias("canonical_key"),
        *[F.nullif(F.col(c), F.lit("")).alias(f"req_{c}") for c in ("province", "region", "constituency")],
        *[c for c in ("category", "election_date") if c in requests.columns],
    )
    on = ["canonical_key", *[c for c in ("category", "election_date") if c in requests.columns]]
    matched = units.join(asked, on).where(scope_predicate())
    return (
        matched.withColumn("college", F.coalesce("college", F.lit("")))
        .withColumn("constituency", F.coalesce("constituency", F.lit("")))
        .groupBy("place", *LAYER, *_UNIT)
        .agg(
            F.max("electors").alias("electors"),
            F.max("voters").alias("voters"),
            F.sum("votes").alias("votes"),
        )
    )


def strict_sum(column: str) -> Column:
    """Sum that is NULL as soon as one addend is."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def layers(units: DataFrame) -> DataFrame:
    """Sum units to municipalities; a measure one unit lacks is unknown."""
    return units.groupBy("place", *LAYER).agg(
        F.count(F.lit(1)).alias("parts"),
        strict_sum("electors").alias("electors"),
        strict_sum("voters").alias("voters"),
        F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"),
    )


_ROW = ("archive", "source_file", "result_type", "round", "parts", "electors", "voters", "votes")


def _pick(candidates: DataFrame, *preference: Column) -> DataFrame:
    # min_by combines map-side; a row_number window would gather whole groups.
    ties = [F.col(c) for c in ("source_file", "result_type", "round", "archive")]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate([*preference, *ties])])
    return (
        candidates.groupBy("place", "category", "election_date")
        .agg(F.min_by(F.struct(*_ROW), order).alias("best"))
        .select("place", "category", "election_date", "best.*")
    )


def best_layer(candidates: DataFrame) -> DataFrame:
    """The layer an audit reads: electors known, lists, voters known, most votes."""
    return _pick(
        candidates,
        F.col("electors").isNull(),
        F.col("result_type") != "list",
        F.col("voters").isNull(),
        -F.col("votes"),
    )


def verification_layer(candidates: DataFrame) -> DataFrame:
    """The layer a verification reads: the first round comes before all else."""
    return _pick(
        candidates,
        ~F.coalesce(F.col("round") == 1, F.lit(False)),
        F.col("round").isNotNull(),
        F.col("electors").isNull(),
        F.col("result_type") != "list",
        F.col("voters").isNull(),
        -F.col("votes"),
    )


def subject_units(facts: DataFrame, *keys: str) -> DataFrame:
    """Votes per subject before a layer is chosen; reduces the facts once."""
    keys = keys or ("place",)
    return (
        facts.where(F.col("municipality").isNotNull())
        .withColumn("subject_key", F.coalesce("subject_key", slug(F.col("subject"))))
        .groupBy(*keys, *LAYER[1:], "subject_key")
        .agg(
            F.sum(F.coalesce("votes", F.lit(0))).alias("votes"),
            F.count(F.lit(1)).alias("parts"),
            F.min("subject").alias("subject"),
        )
    )


def subject_totals(units: DataFrame, chosen: DataFrame) -> DataFrame:
    """Votes, rows and first label per subject within each chosen layer.

    A layer without a round takes every round, as published.
    """
    layer = chosen.select(
        "place", "category", "election_date", "source_file", "result_type",
        F.col("round").alias("layer_round"),
    )
    joined = units.join(
        layer, ["place", "category", "election_date", "source_file", "result_type"]
    ).where(F.col("layer_round").isNull() | (F.col("round") == F.col("layer_round")))
    return joined.groupBy(
        "place", "category", "election_date", "source_file", "result_type", "layer_round",
        "subject_key",
    ).agg(
        F.sum("votes").alias("votes"),
        F.sum("parts").alias("parts"),
        F.min("subject").alias("subject"),
    )


def requested_subject_units(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """Subject units for a table of requests, by the same scope rule as units."""
    reduced = subject_units(with_keys(facts), "canonical_key", "province", "region", "constituency")
    named = [c for c in ("category", "election_date") if c in requests.columns]
    asked = requests.select(
        "place",
        slug(canonical_municipality(F.col("municipality"))).alias("canonical_key"),
        *[F.nullif(F.col(c), F.lit("")).alias(f"req_{c}") for c in ("province", "region", "constituency")],
        *named,
    )
    matched = reduced.join(asked, ["canonical_key", *named]).where(scope_predicate())
    return matched.groupBy("place", *LAYER[1:], "subject_key").agg(
        F.sum("votes").alias("votes"),
        F.sum("parts").alias("parts"),
        F.min("subject").alias("subject"),
    )
