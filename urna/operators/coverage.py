"""Geographic coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.text import ascii_lower, slug
from urna.operators.facts import ordered
from urna.session import stage

_NATIONAL_KEYS = (
    "category", "election_date", "region", "constituency", "province", "municipality",
    "country", "college", "round", "question_number",
)


def national_coverage(facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per archive and published geography: files, rows, subjects, maxima.

    Rows are first reduced to (geography, file, subject), so a geography that
    holds a large share of all rows reaches the final step pre-aggregated and
    the distinct counts need no row expansion.
    """
    keys = ("archive", *_NATIONAL_KEYS)
    reduced = facts.groupBy(*keys, "source_file", "subject_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("electors").alias("electors"),
        F.max("voters").alias("voters"),
        F.max("valid_votes").alias("valid_votes"),
    )
    grouped = reduced.groupBy(*keys).agg(
        F.sort_array(F.collect_set("source_file")).alias("files"),
        F.sum("n").alias("rows"),
        F.countDistinct("subject_key").alias("subjects"),
        F.max("electors").alias("electors"),
        F.max("voters").alias("voters"),
        F.max("valid_votes").alias("valid_votes"),
    )
    joined = grouped.join(catalogue.select("archive", "download_url", "sha256"), "archive")
    level = (
        F.when(F.col("municipality") != "", "comune")
        .when(F.col("province") != "", "provincia")
        .when(F.col("region") != "", "regione")
        .when(F.col("country") != "", "nazione")
        .otherwise("nazionale")
    )
    columns = {
        "tipo_elezione": F.col("category"), "data": F.col("election_date"), "livello": level,
        "regione": F.col("region"), "circoscrizione": F.col("constituency"),
        "provincia": F.col("province"), "comune": F.col("municipality"),
        "nazione": F.col("country"), "collegio": F.col("college"), "turno": F.col("round"),
        "numero_quesito": F.col("question_number"), "righe": F.col("rows"),
        "soggetti": F.col("subjects"), "elettori": F.col("electors"),
        "votanti": F.col("voters"), "voti_validi": F.col("valid_votes"),
        "fonte_file": F.array_join("files", ","), "file_count": F.size("files").cast("bigint"),
        "fonte_url": F.col("download_url"), "sha256": F.col("sha256"),
    }
    return joined.select(*[columns[name].alias(name) for name in fv.COVERAGE_COLUMNS])


def municipality_coverage(
    facts: DataFrame, catalogue: DataFrame, requests: DataFrame
) -> DataFrame:
    """Is each requested municipality present in each relevant archive?

    ``requests`` holds (region, municipality).  Relevant are the archives of the
    national categories and those with rows of the region or the municipality.
    An election may have several archives, each reported on its own.  The facts
    are reduced to one small row per (archive, region, municipality) once; requests
    meet archives through equi-joins only.
    """
    archive = ["category", "election_date", "archive"]
    # Written once: what follows reads it four times, the facts only here.
    reduced = stage(
        facts.groupBy(*archive, "region", "municipality_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("municipality").alias("n_municipal"),
        )
        .withColumn("region_key", ascii_lower(F.col("region")))
    )
    level_rows = reduced.groupBy(*archive).agg(F.sum("n_municipal").alias("righe_livello_comunale"))
    by_place = reduced.groupBy(*archive, "municipality_key").agg(F.sum("n").alias("righe_comune"))
    by_region = reduced.select(*archive, "region_key").distinct()

    asked = requests.select(
        "region",
        "municipality",
        ascii_lower(F.col("region")).alias("region_key"),
        slug(F.col("municipality")).alias("municipality_key"),
    ).distinct()
    national = asked.withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in fv.NATIONAL_CATEGORIES]))
    ).join(catalogue.select(*archive), "category")
    touched = asked.join(by_region, "region_key").select(*national.columns)
    named = asked.join(by_place.drop("righe_comune"), "municipality_key").select(*national.columns)
    relevant = national.unionByName(touched).unionByName(named).distinct()

    out = (
        relevant.join(by_place, [*archive, "municipality_key"], "left")
        .join(level_rows, archive, "left")
        .join(catalogue, archive)
    )
    here = F.coalesce("righe_comune", F.lit(0))
    level = F.coalesce("righe_livello_comunale", F.lit(0))
    return out.select(
        F.col("category").alias("tipo_elezione"),
        F.col("election_date").alias("data"),
        "filename",
        F.col("region").alias("regione"),
        F.col("municipality").alias("comune"),
        F.when(here > 0, "present")
        .when(level == 0, "not_available_at_municipality_level")
        .otherwise("missing")
        .alias("stato"),
        here.alias("righe_comune"),
        level.alias("righe_livello_comunale"),
        F.col("download_url").alias("fonte_url"),
        "sha256",
    )


def status_tally(rows: DataFrame, by: list[str], statuses: tuple[str, ...]) -> DataFrame:
    """Rows checked and rows per status, per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col("stato") == s).alias(s) for s in statuses],
    )


def municipality_list(raw: DataFrame) -> DataFrame:
    """Municipalities of each election with province, region and row count."""
    return (
        raw.where(F.col("municipality").isNotNull())
        .groupBy("category", "election_date", "municipality_key", "municipality")
        .agg(
            F.max("province").alias("provincia"),
            F.max("region").alias("regione"),
            F.count(F.lit(1)).alias("rows"),
        )
        .withColumnRenamed("municipality", "comune")
    )


def nocase_keys() -> tuple:
    """The order of the municipality list: by name without regard to ASCII case."""
    return ("category", "election_date", ascii_lower(F.col("comune")).asc_nulls_first(), "comune", "municipality_key")


def nocase_order(municipalities: DataFrame) -> DataFrame:
    return ordered(municipalities, nocase_keys())


def imported_elections(facts: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Elections with result rows, in date order."""
    return (
        facts.where(F.col("category").isin(*categories))
        .select("category", "election_date")
        .distinct()
        .orderBy("election_date", "category")
    )


def import_totals(raw: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Files, raw rows, result rows and municipal party rows per archive."""
    files = raw.groupBy(*keys, "file_name").agg(F.count(F.lit(1)).alias("n"))
    read = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows")
    )
    municipal = (
        (F.col("category") == "comunali")
        & (F.col("result_type") == "list")
        & (F.col("municipality") != "")
        & (F.col("party") != "")
    )
    results = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("result_rows"), F.count_if(municipal).alias("party_rows")
    )
    return read.join(results, keys, "left").na.fill(0, ["result_rows", "party_rows"])
