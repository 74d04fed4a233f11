"""Temporal audit of reconstructed municipalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.numbers import ratio
from urna.functions.text import slug
from urna.operators.coverage import status_tally
from urna.operators.maps import with_map_version

STATUSES = ("pass", "warning", "invalid", "insufficient_data")


def newest_verification(places: DataFrame, verifications: DataFrame) -> DataFrame:
    """Newest stored verification per place, category and date.

    A place is found under its geography key, its constituency key or the old
    bare key; the bare key counts only if the stored geography agrees.  The up
    to three keys are exploded into one equi-join.  ``places`` holds (place,
    municipality_key, province, region, constituency).
    """
    scoped = (F.col("province") != "") | (F.col("region") != "")
    geography = (
        F.when(F.col("province") != "", F.concat(F.lit("p:"), slug(F.col("province")), F.lit("|"), "municipality_key"))
        .when(F.col("region") != "", F.concat(F.lit("r:"), slug(F.col("region")), F.lit("|"), "municipality_key"))
        .otherwise(F.col("municipality_key"))
    )
    constituency = F.when(
        F.col("constituency") != "",
        F.concat(F.lit("c:"), slug(F.col("constituency")), F.lit("|"), "municipality_key"),
    )
    keys = places.select(
        "place",
        F.col("municipality_key").alias("bare"),
        F.coalesce(scoped, F.lit(False)).alias("scoped"),
        (F.col("province") != "").alias("by_province"),
        F.when(F.col("province") != "", slug(F.col("province")))
        .otherwise(slug(F.col("region")))
        .alias("wanted"),
        F.explode(
            F.array_distinct(F.array_compact(F.array(geography, constituency, F.col("municipality_key"))))
        ).alias("verification_key"),
    )
    found = keys.join(verifications, "verification_key").where(
        ~(F.col("scoped") & (F.col("verification_key") == F.col("bare")))
        | (
            F.coalesce(
                slug(F.when(F.coalesce("by_province", F.lit(False)), F.col("source_province")).otherwise(F.col("source_region"))),
                F.lit(""),
            )
            == F.col("wanted")
        )
    )
    stored = (
        "status", "complete_set", "official_pages", "official_electors", "official_voters",
        "official_valid_votes", "source_urls", "verified_at",
    )
    return (
        found.groupBy("place", "category", "election_date")
        .agg(F.max_by(F.struct(*stored), F.struct("verified_at", "verification_key")).alias("v"))
        .select("place", "category", "election_date", "v")
    )


def overlay(layers: DataFrame, newest: DataFrame) -> DataFrame:
    """Let verified complete page sets replace the reconstructed figures."""
    joined = layers.join(newest, ["place", "category", "election_date"], "left")
    trusted = F.coalesce(F.col("v.complete_set"), F.lit(False))

    def replaced(official: str, own: str) -> Column:
        return F.when(trusted, F.coalesce(F.col(f"v.{official}"), F.col(own))).otherwise(F.col(own))

    return joined.select(
        "place", "category", "election_date", "source_file", "result_type", "round", "parts",
        replaced("official_electors", "electors").alias("electors"),
        replaced("official_voters", "voters").alias("voters"),
        replaced("official_valid_votes", "votes").alias("votes"),
        F.when(trusted, "official_municipality_pages").otherwise("open_data").alias("fonte_aggregazione"),
        F.when(trusted, F.col("electors")).alias("electors_open_data"),
        F.when(trusted, F.col("voters")).alias("voters_open_data"),
        F.when(trusted, F.col("votes")).alias("votes_open_data"),
        F.col("v.status").alias("verifica_ufficiale_stato"),
        F.coalesce(F.col("v.official_pages"), F.lit(0)).cast("bigint").alias("verifica_ufficiale_pagine"),
        F.coalesce(F.col("v.source_urls"), F.array().cast("array<string>")).alias("verifica_ufficiale_fonti"),
        F.col("v.verified_at").alias("verifica_ufficiale_data"),
    )


def no_overlay(layers: DataFrame) -> DataFrame:
    """Layers in the shape :func:`overlay` gives, nothing verified."""
    whole, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    return layers.select(
        "place", "category", "election_date", "source_file", "result_type", "round", "parts",
        "electors", "voters", "votes",
        F.lit("open_data").alias("fonte_aggregazione"),
        whole.alias("electors_open_data"),
        whole.alias("voters_open_data"),
        whole.alias("votes_open_data"),
        text.alias("verifica_ufficiale_stato"),
        F.lit(0).cast("bigint").alias("verifica_ufficiale_pagine"),
        F.array().cast("array<string>").alias("verifica_ufficiale_fonti"),
        F.lit(None).cast("timestamp").alias("verifica_ufficiale_data"),
    )


def _nonzero(column: str) -> Column:
    return F.coalesce(F.col(column) != 0, F.lit(False))


def _other_chamber(measure: str, same_date) -> Column:
    """First other category of the date with a usable measure (one struct)."""
    # At most one entry per category: the list is bounded by the eight categories.
    listed = F.collect_list(
        F.when(_nonzero(measure), F.struct("category", F.col(measure).alias("value")))
    ).over(same_date)
    return F.array_min(
        F.filter(listed, lambda other: other["category"] != F.col("category"))
    )


def temporal_audit(
    rows: DataFrame,
    *,
    categories: tuple[str, ...] = fv.AUDIT_CATEGORIES,
    voter_tolerance: float = 0.35,
) -> DataFrame:
    """Judge each reconstructed election against its neighbours.

    ``rows`` is the output of :func:`overlay`.  Both chambers always serve as
    reference; the output keeps the requested categories.  Windows run over one
    row per election of a place, never over result rows.
    """
    if not 0 <= voter_tolerance < 1:
        raise ValueError("voter_tolerance must be at least 0 and below 1")
    base = rows.where(F.col("category").isin(*dict.fromkeys((*categories, *fv.AUDIT_CATEGORIES))))

    day = F.col("election_date")
    history = Window.partitionBy("place", "category").orderBy("election_date")
    before = history.rowsBetween(Window.unboundedPreceding, -1)
    after = history.rowsBetween(1, Window.unboundedFollowing)
    same_date = Window.partitionBy("place", "election_date")

    def neighbour(measure: str) -> Column:
        return F.when(
            _nonzero(measure), F.struct(day.alias("day"), F.col(measure).alias("value"))
        )

    seen = (
        base.withColumn("prev_e", F.last(neighbour("electors"), True).over(before))
        .withColumn("next_e", F.first(neighbour("electors"), True).over(after))
        .withColumn("prev_v", F.last(neighbour("voters"), True).over(before))
        .withColumn("next_v", F.first(neighbour("voters"), True).over(after))
        .withColumn("same_e", _other_chamber("electors", same_date))
        .withColumn("same_v", _other_chamber("voters", same_date))
    )
    closer_is_previous = F.col("prev_e").isNotNull() & (
        F.col("next_e").isNull()
        | (
            F.datediff(day, F.col("prev_e.day"))
            <= F.datediff(F.col("next_e.day"), day)
        )
    )
    nearest = F.when(closer_is_previous, F.col("prev_e")).otherwise(F.col("next_e"))
    has_same_e, has_same_v = F.col("same_e").isNotNull(), F.col("same_v").isNotNull()
    voters = F.nullif(F.col("voters"), F.lit(0).cast("bigint"))
    referenced = (
        seen.withColumn("nearest", nearest)
        .withColumn(
            "data_riferimento", F.when(has_same_e, day).otherwise(F.col("nearest.day"))
        )
        .withColumn(
            "tipo_elezione_riferimento",
            F.when(has_same_e, F.col("same_e.category")).when(
                F.col("nearest").isNotNull(), F.col("category")
            ),
        )
        .withColumn(
            "metodo_riferimento",
            F.when(has_same_e, "same_date_other_chamber").when(
                F.col("nearest").isNotNull(), "adjacent_same_chamber"
            ),
        )
        .withColumn(
            "aventi_diritto_riferimento",
            F.when(has_same_e, F.col("same_e.value")).otherwise(F.col("nearest.value")),
        )
        .withColumn(
            "metodo_confronto_votanti",
            F.when(has_same_v, "same_date_other_chamber").when(
                F.col("prev_v").isNotNull() | F.col("next_v").isNotNull(), "adjacent_same_chamber"
            ),
        )
        .withColumn("data_precedente", F.when(~has_same_v, F.col("prev_v.day")))
        .withColumn("votanti_precedenti", F.when(~has_same_v, F.col("prev_v.value")))
        .withColumn("data_successiva", F.when(~has_same_v, F.col("next_v.day")))
        .withColumn("votanti_successivi", F.when(~has_same_v, F.col("next_v.value")))
        .withColumn("tipo_elezione_stessa_data", F.col("same_v.category"))
        .withColumn("votanti_stessa_data", F.col("same_v.value"))
        .withColumn("rapporto_voti_aventi_diritto", ratio(F.col("votes"), F.nullif(F.col("electors"), F.lit(0).cast("bigint"))))
        .withColumn(
            "rapporto_aventi_diritto_riferimento",
            ratio(F.col("electors"), F.col("aventi_diritto_riferimento")),
        )
        .withColumn("rapporto_votanti_stessa_data", ratio(voters, F.col("votanti_stessa_data")))
        .withColumn("rapporto_votanti_precedenti", ratio(voters, F.col("votanti_precedenti")))
        .withColumn("rapporto_votanti_successivi", ratio(voters, F.col("votanti_successivi")))
    )

    low, high = 1 - voter_tolerance, 1 + voter_tolerance
    voter_ratios = [
        F.col(f"rapporto_votanti_{x}") for x in ("stessa_data", "precedenti", "successivi")
    ]
    any_ratio = F.coalesce(*voter_ratios).isNotNull()
    comparable = F.lit(True)
    for value in voter_ratios:
        comparable = comparable & F.coalesce(value.between(low, high), F.lit(True))
    comparable = F.when(any_ratio, comparable)

    electors, votes = F.col("electors"), F.col("votes")

    def true(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    invalid = (
        true((electors != 0) & (votes > electors * F.lit(1.02)))
        | true((electors != 0) & (F.col("voters") > electors * F.lit(1.01)))
        | true(votes > F.col("voters") * F.lit(1.02))
    )
    insufficient = ~_nonzero("electors") | ~_nonzero("voters") | ~any_ratio
    warning = (
        ~true(F.col("rapporto_voti_aventi_diritto").between(0.2, 1.02))
        | true(~F.col("rapporto_aventi_diritto_riferimento").between(0.65, 1.35))
        | true(~comparable)
    )
    judged = (
        referenced.withColumn("votanti_comparabili", comparable)
        .withColumn("tolleranza_votanti", F.lit(float(voter_tolerance)))
        .withColumn(
            "stato",
            F.when(invalid, "invalid")
            .when(insufficient, "insufficient_data")
            .when(warning, "warning")
            .otherwise("pass"),
        )
        .where(F.col("category").isin(*categories))
    )
    mapped = with_map_version(judged)
    return mapped.drop("prev_e", "next_e", "prev_v", "next_v", "same_e", "same_v", "nearest").withColumnsRenamed(
        {"map_id": "mappa_collegi_versione", "map_source_ids": "fonti_confini_ids"}
    ).withColumn("fonte_confini_id", F.try_element_at("fonti_confini_ids", F.lit(1)))


def audit_summary(audit: DataFrame, by: list[str]) -> DataFrame:
    """Elections checked and their statuses, per group."""
    return status_tally(audit, by, STATUSES)
