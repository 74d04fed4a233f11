"""Two-source verification of municipality pages against reconstructed layers.

Pages hold: url, category, election_date, municipality, province, region,
constituency, electors, voters, college_code and ``records`` (position,
record_type, name, round, votes, percentage, seats).  A page set is the pages
of one place and date; ``place`` names the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna.functions.text import canonical_municipality, geography_key, slug
from urna.operators import layers as lay
from urna.operators.maps import with_map_version
from urna.session import stage

SET = ("place", "category", "election_date")
_TOTALS = ("total", "coalition_total")


def page_sets(pages: DataFrame) -> DataFrame:
    """Assign municipality pages to sets by geography key and date.

    Which elections' pages may be used is up to ``traversal.complete_leaves``.
    """
    leaves = pages.where(canonical_municipality(F.col("municipality")).isNotNull())
    return leaves.withColumn(
        "place",
        geography_key(
            canonical_municipality(F.col("municipality")),
            F.col("province"), F.col("region"), F.col("constituency"),
        ),
    )


def page_set_rejects(sets: DataFrame) -> DataFrame:
    """Sets that mix places or publish no geography, with the first broken rule."""

    def mixed(value: Column) -> Column:
        folded = F.coalesce(slug(value), F.lit(""))
        return F.min(folded) != F.max(folded)

    flags = sets.groupBy("set_id").agg(
        (F.min(F.coalesce("category", F.lit(""))) != F.max(F.coalesce("category", F.lit("")))).alias("chamber"),
        (F.count("category") == 0).alias("unsupported"),
        (F.min("election_date") != F.max("election_date")).alias("election_date"),
        mixed(canonical_municipality(F.col("municipality"))).alias("municipality"),
        F.min(canonical_municipality(F.col("municipality"))).isNull().alias("unnamed"),
        mixed(F.col("province")).alias("province"),
        mixed(F.col("region")).alias("region"),
        mixed(F.col("constituency")).alias("constituency"),
        F.max(
            F.coalesce(F.nullif("province", F.lit("")), F.nullif("region", F.lit("")), F.nullif("constituency", F.lit("")))
        ).isNull().alias("nowhere"),
    )
    reason = (
        F.when(F.col("unsupported"), "unsupported_category")
        .when(F.col("unnamed"), "municipality_missing")
        .when(F.col("nowhere"), "geography_missing")
    )
    for rule in ("chamber", "election_date", "municipality", "province", "region", "constituency"):
        reason = reason.when(F.col(rule), f"different_{rule}")
    return flags.select("set_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def set_summaries(sets: DataFrame) -> DataFrame:
    """Per set: pages, null-strict electors and voters, scope of the comparison."""
    scoped = (F.col("province") != "") | (F.col("region") != "")
    return sets.groupBy(*SET).agg(
        F.count(F.lit(1)).alias("pages"),
        lay.strict_sum("electors").alias("official_electors"),
        lay.strict_sum("voters").alias("official_voters"),
        F.max(canonical_municipality(F.col("municipality"))).alias("municipality"),
        F.max("province").alias("province"),
        F.max("region").alias("region"),
        F.max(F.when(~F.coalesce(scoped, F.lit(False)), F.col("constituency"))).alias("constituency"),
        F.max("constituency").alias("published_constituency"),
    )


def _records(sets: DataFrame) -> DataFrame:
    return sets.select(*SET, "url", F.explode("records").alias("r")).select(
        *SET, "url", "r.*", slug(F.col("r.name")).alias("subject_key")
    )


def official_totals(sets: DataFrame) -> DataFrame:
    """Published subjects of a page set, summed over its pages.

    Round 0 and no round are one key (-1).  A percentage survives only where
    the set is a single page.
    """
    records = _records(sets).where(~F.col("record_type").isin(*_TOTALS))
    keyed = records.withColumn(
        "round_key", F.coalesce(F.nullif(F.col("round").cast("bigint"), F.lit(0).cast("bigint")), F.lit(-1))
    )
    first = F.struct("url", "position")
    return (
        keyed.groupBy(*SET, "record_type", "subject_key", "round_key")
        .agg(
            F.sum("votes").alias("votes"),
            F.sum("seats").alias("seats"),
            F.count(F.lit(1)).alias("components"),
            F.min_by("name", first).alias("subject"),
            F.min_by("percentage", first).alias("percentage"),
            F.min(first).alias("first"),
        )
        .join(sets.groupBy(*SET).agg(F.count(F.lit(1)).alias("pages")), list(SET))
        .withColumn("percentage", F.when(F.col("pages") == 1, F.col("percentage")))
        .drop("pages")
    )


def official_valid_votes(sets: DataFrame, totals: DataFrame) -> DataFrame:
    """Valid votes: published totals of the first round, else summed subjects."""
    first_round = F.col("round").isNull() | (F.col("round") == 1)
    printed = (
        _records(sets)
        .where((F.col("record_type") == "total") & first_round & F.col("votes").isNotNull())
        .groupBy(*SET)
        .agg(F.sum("votes").alias("printed"))
    )
    usable = F.col("round_key").isin(-1, 1)

    def of(kind: str) -> list[Column]:
        here = usable & (F.col("record_type") == kind)
        return [
            F.max(here).alias(f"has_{kind}"),
            F.sum(F.when(here, F.col("votes"))).alias(f"sum_{kind}"),
        ]

    summed = totals.groupBy(*SET).agg(*of("list"), *of("candidate"), *of("option"))
    fallback = F.when(F.col("has_list"), F.col("sum_list")).when(
        F.col("has_candidate"), F.col("sum_candidate")
    ).when(F.col("has_option"), F.col("sum_option"))
    return (
        sets.select(*SET).distinct()
        .join(summed, list(SET), "left")
        .join(printed, list(SET), "left")
        .select(*SET, F.coalesce("printed", fallback, F.lit(0)).alias("official_valid_votes"))
    )


def local_layers(facts: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconstructed layer and subject totals of each page set."""
    requests = summaries.select(*SET, "municipality", "province", "region", "constituency")
    units = lay.requested_units(lay.geography_units(facts), requests)
    # The chosen layer feeds every comparison; one row per set is cheap to stage.
    chosen = stage(lay.verification_layer(lay.layers(units)))
    subjects = lay.requested_subject_units(facts, requests)
    return chosen, lay.subject_totals(subjects, chosen)


def _relative(official: Column, local: Column) -> Column:
    gap = F.abs(local - official)
    return F.when(official != 0, gap / official).otherwise((gap != 0).cast("double"))


def compare_fields(
    summaries: DataFrame, valid: DataFrame, chosen: DataFrame, *, tolerance: float = 0.0
) -> DataFrame:
    """Electors, voters and valid votes of both sources, three rows per set."""
    local = chosen.select(*SET, "electors", "voters", "votes")
    joined = summaries.join(valid, list(SET)).join(local, list(SET), "left")

    def field(name: str, official: str, rebuilt: str) -> Column:
        return F.struct(
            F.lit(name).alias("campo"),
            F.col(official).alias("ufficiale"),
            F.col(rebuilt).alias("ricostruito"),
        )

    pairs = F.array(
        field("aventi_diritto", "official_electors", "electors"),
        field("votanti", "official_voters", "voters"),
        field("voti_validi", "official_valid_votes", "votes"),
    )
    rows = joined.select(*SET, F.explode(pairs).alias("c")).select(*SET, "c.*")
    official, local_value = F.col("ufficiale"), F.col("ricostruito")
    both = official.isNotNull() & local_value.isNotNull()
    relative = _relative(official, local_value)
    return rows.select(
        *SET, "campo", "ufficiale", "ricostruito",
        F.when(both, local_value - official).alias("scarto"),
        F.when(both, F.bround(relative, 8)).alias("scarto_relativo"),
        F.when(both, relative <= tolerance).alias("coincide"),
    )


def compare_subjects(
    totals: DataFrame, chosen: DataFrame, local: DataFrame, *, tolerance: float = 0.0
) -> DataFrame:
    """Subject by subject: match, within tolerance, mismatch or missing on a side."""
    kind = chosen.select(*SET, F.col("result_type").alias("layer_type"))
    official = (
        totals.join(kind, list(SET), "left")
        .where(F.col("record_type") == F.coalesce("layer_type", F.lit("list")))
        .where(F.col("round_key").isin(-1, 1) & F.col("votes").isNotNull())
        .groupBy(*SET, "subject_key")
        .agg(F.max_by(F.struct("subject", "votes"), "first").alias("o"))
        .select(*SET, "subject_key", F.col("o.subject").alias("partito_ufficiale"), F.col("o.votes").alias("voti_ufficiali"))
    )
    rebuilt = local.select(
        *SET, "subject_key",
        F.col("subject").alias("partito_ricostruito"),
        F.col("votes").alias("voti_ricostruiti"),
    )
    joined = official.join(rebuilt, [*SET, "subject_key"], "full_outer")
    o, r = F.col("voti_ufficiali"), F.col("voti_ricostruiti")
    relative = _relative(o, r)
    return joined.select(
        *SET, "subject_key", "partito_ufficiale", "partito_ricostruito",
        "voti_ufficiali", "voti_ricostruiti",
        (r - o).alias("scarto"),
        F.bround(relative, 8).alias("scarto_relativo"),
        F.when(o.isNull(), "missing_official")
        .when(r.isNull(), "missing_local")
        .when(r == o, "match")
        .when(relative <= tolerance, "within_tolerance")
        .otherwise("mismatch")
        .alias("stato"),
    )


def verification_status(
    summaries: DataFrame, chosen: DataFrame, fields: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Overall outcome per page set."""
    agree = F.col("stato").isin("match", "within_tolerance")
    by_subject = subjects.groupBy(*SET).agg(
        F.count(F.lit(1)).alias("partiti_confrontati"),
        F.count_if(agree).alias("partiti_coincidenti"),
        F.count_if(~agree).alias("partiti_non_coincidenti"),
        F.count_if(F.col("stato") == "within_tolerance").alias("tolerated"),
    )
    by_field = fields.groupBy(*SET).agg(
        F.count_if(~F.col("coincide")).alias("fields_apart"),
        F.count_if(F.col("scarto") != 0).alias("fields_moved"),
    )
    joined = (
        summaries.join(chosen.select(*SET, F.col("parts")), list(SET), "left")
        .join(by_subject, list(SET), "left")
        .join(by_field, list(SET))
        .na.fill(0, ["partiti_confrontati", "partiti_coincidenti", "partiti_non_coincidenti", "tolerated"])
    )
    status = (
        F.when(F.col("parts").isNull(), "local_data_missing")
        .when((F.col("partiti_non_coincidenti") > 0) | (F.col("fields_apart") > 0), "mismatch")
        .when((F.col("tolerated") > 0) | (F.col("fields_moved") > 0), "within_tolerance")
        .otherwise("exact_match")
    )
    return joined.withColumn("stato", status).withColumn(
        "pezzi_open_data", F.coalesce("parts", F.lit(0))
    ).drop("parts", "tolerated", "fields_apart", "fields_moved")


def legal_colleges(elections: DataFrame, registry: DataFrame) -> DataFrame:
    """Colleges the decree in force assigns to each (category, date, municipality, geography).

    No extracted table for the map: ``collegi_legali`` is NULL.  A table without
    the place: an empty list.  A missing geography matches any.  College
    numbers are distinct integers of one decree, hence few.
    """
    asked = (
        with_map_version(elections)
        .withColumn("legal_municipality", slug(F.col("municipality")))
        .withColumn("legal_geography", F.coalesce(slug(F.col("geography")), F.lit("")))
    )
    listed = registry.where(F.col("municipality") != "").select(
        F.col("map_version").alias("map_id"),
        slug(F.col("geography")).alias("registry_geography"),
        slug(F.col("municipality")).alias("legal_municipality"),
        F.col("college").cast("int").alias("college"),
    ).distinct()
    extracted = registry.select(F.col("map_version").alias("map_id")).distinct().withColumn(
        "extracted", F.lit(True)
    )
    keys = [*elections.columns, "map_id", "map_source_ids", "legal_municipality", "legal_geography"]
    matched = asked.join(listed, ["map_id", "legal_municipality"], "left")
    in_place = (F.col("legal_geography") == "") | (F.col("registry_geography") == F.col("legal_geography"))
    return (
        matched.groupBy(*keys)
        .agg(F.sort_array(F.collect_set(F.when(in_place, F.col("college")))).alias("found"))
        .join(extracted, "map_id", "left")
        .withColumn("collegi_legali", F.when(F.col("extracted"), F.col("found")))
        .drop("found", "extracted", "legal_municipality", "legal_geography")
    )


def legal_piece_count(sets: DataFrame, registry: DataFrame) -> DataFrame:
    """Pages' own college numbers against the decree's colleges."""
    website = sets.groupBy(*SET).agg(
        F.count(F.lit(1)).alias("pagine"),
        F.max(canonical_municipality(F.col("municipality"))).alias("municipality"),
        F.max(F.when(F.col("category") == "camera", F.col("constituency")).otherwise(F.col("region"))).alias("geography"),
        F.sort_array(
            F.collect_set(F.when(F.col("college_code").rlike("^[0-9]+$"), F.col("college_code").try_cast("int")))
        ).alias("collegi_pagine"),
    )
    legal = legal_colleges(website, registry)
    count, own = F.size("collegi_legali"), F.size("collegi_pagine")
    outcome = (
        F.when(F.col("collegi_legali").isNull(), "not_available")
        .when(count == 0, "not_found")
        .when(
            own == F.col("pagine"),
            F.when(F.col("collegi_pagine") == F.col("collegi_legali"), "pass").otherwise("mismatch"),
        )
        .when(F.col("pagine") == count, "pass")
        .otherwise("mismatch")
    )
    return legal.withColumn("stato", outcome).select(
        *SET, "pagine", "stato", "collegi_pagine", "collegi_legali", F.col("map_id").alias("mappa_collegi_versione")
    )


def closure_outcome(sets: DataFrame, closures: DataFrame, edges: DataFrame) -> DataFrame:
    """pass if the parents of all pages close, fail otherwise, not_available without any."""
    status = edges.select(
        F.col("child_url").alias("url"), "parent_url"
    ).join(closures.select("parent_url", F.col("status").alias("closure")), "parent_url")
    joined = sets.select(*SET, "url").join(status, "url", "left")
    closed = F.coalesce(F.col("closure") == "closed", F.lit(False))
    return joined.groupBy(*SET).agg(
        F.when(F.count("closure") == 0, "not_available")
        .when(F.bool_and(closed), "pass")
        .otherwise("fail")
        .alias("closure_check")
    )


def completeness(
    status: DataFrame, closure: DataFrame, legal: DataFrame, *, complete_set: bool = True
) -> DataFrame:
    """complete, or incomplete with the reasons in their fixed order."""
    joined = status.join(closure, list(SET), "left").join(
        legal.select(*SET, F.col("stato").alias("legal_check")), list(SET), "left"
    )
    check = F.coalesce("closure_check", F.lit("not_available"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("stato") != "exact_match", "piece_match"),
            F.when(check != "pass", F.concat(F.lit("college_closure_"), check)),
            F.when(F.col("legal_check") == "mismatch", "legal_piece_count"),
            F.when(F.lit(not complete_set), "page_set_not_declared_complete"),
        )
    )
    return joined.withColumn("completezza_motivi", reasons).withColumn(
        "completezza", F.when(F.size("completezza_motivi") == 0, "complete").otherwise("incomplete")
    )
