"""Fact-table reads, coverage and map queries, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna import reference_data
from urna.functions.numbers import parts_per_million
from urna.functions.text import canonical_municipality, geography_key, slug
from urna.operators import coverage, facts as reads, maps
from urna.plans.election_view import (
    archives, facts, election_rows, sql_canonical, sql_facts, sql_slug, table,
)
from urna.plans.shape import plain, sql_ppm

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _in_ppm(df: DataFrame) -> DataFrame:
    return plain(
        df.withColumn("percentuale_ppm", parts_per_million(F.col("voti"), F.col("voti_validi")))
        .withColumn("affluenza_ppm", parts_per_million(F.col("votanti"), F.col("elettori")))
        .drop("percentuale", "affluenza_pct")
    )


_RESULT_SELECT = f"""
SELECT f.category AS tipo_elezione, CAST(f.election_date AS VARCHAR) AS data, round AS turno,
       region AS regione, constituency AS circoscrizione, province AS provincia,
       municipality AS comune,
       CASE WHEN municipality IS NOT NULL AND province IS NOT NULL THEN
            concat(CAST(f.election_date AS VARCHAR),'|',{sql_slug('province')},'|',{sql_slug('municipality')})
       END AS chiave_comune_tornata,
       CASE WHEN municipality IS NULL THEN 'non_municipal'
            WHEN province IS NOT NULL AND region IS NOT NULL THEN 'region_province_municipality'
            WHEN province IS NOT NULL THEN 'province_municipality'
            WHEN region IS NOT NULL THEN 'region_municipality_incomplete'
            ELSE 'municipality_incomplete' END AS stato_localizzazione,
       country AS nazione, college AS collegio, question_number AS numero_quesito,
       CAST(NULL AS VARCHAR) AS quesito, result_type AS tipo_risultato, subject AS soggetto,
       CASE WHEN result_type='list' THEN subject END AS partito,
       CASE WHEN result_type<>'list' THEN subject END AS candidato,
       CAST(NULL AS VARCHAR) AS opzione_referendum, votes AS voti,
       {sql_ppm('votes', 'valid_votes')} AS percentuale_ppm, seats AS seggi,
       electors AS elettori, CAST(NULL AS BIGINT) AS elettori_maschi, voters AS votanti,
       CAST(NULL AS BIGINT) AS votanti_maschi, {sql_ppm('voters', 'electors')} AS affluenza_ppm,
       valid_votes AS voti_validi, CAST(NULL AS BIGINT) AS voti_validi_liste,
       CAST(NULL AS BIGINT) AS voti_validi_candidato, blank_ballots AS schede_bianche,
       CAST(NULL AS BIGINT) AS schede_non_valide, CAST(NULL AS BIGINT) AS schede_contestate,
       ar.download_url AS fonte_url, source_file AS fonte_file, source_row AS fonte_riga, ar.sha256
FROM f JOIN ar ON f.category=ar.category AND f.election_date=ar.election_date
"""


@query(sql_facts() + _RESULT_SELECT)
def history_results(spark, sf_dir):
    rows = reads.with_archive(facts(spark, sf_dir), archives(spark, sf_dir))
    return _in_ppm(reads.result_rows(rows))


_FILTERED = (
    "WHERE f.category='camera' AND year(f.election_date)=1996 AND lower(region)='asia' "
    "AND result_type='list' AND mkey='roma' AND round=2"
)


@query(sql_facts() + _RESULT_SELECT + _FILTERED)
def history_filtered(spark, sf_dir):
    wanted = reads.filter_results(
        facts(spark, sf_dir), category="camera", year=1996, region="Asia",
        municipality="Roma", result_type="list", round_number=2,
    )
    return _in_ppm(reads.result_rows(reads.with_archive(wanted, archives(spark, sf_dir))))


_ORDER_SQL = (
    "ORDER BY f.election_date NULLS FIRST, f.category NULLS FIRST, region NULLS FIRST, "
    "province NULLS FIRST, municipality NULLS FIRST, question_number NULLS FIRST, "
    "result_type NULLS FIRST, subject NULLS FIRST, source_file NULLS FIRST, source_row NULLS FIRST"
)


@query(
    sql_facts()
    + f"SELECT q.*, row_number() OVER () AS position FROM ({_RESULT_SELECT} {_ORDER_SQL} LIMIT 1000 OFFSET 500) q"
)
def history_page(spark, sf_dir):
    page = reads.page(facts(spark, sf_dir), reads.RESULT_ORDER, limit=1000, offset=500)
    # The page holds at most 5,000 rows, so numbering it in one task is bounded.
    numbered = page.withColumn(
        "position",
        F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in reads.RESULT_ORDER])),
    )
    rows = reads.with_archive(numbered, archives(spark, sf_dir))
    return _in_ppm(reads.result_rows(rows, "position"))


@query(sql_facts() + "SELECT count(*) AS total FROM f WHERE category IN ('camera','senato') AND year(election_date)=1997")
def history_count(spark, sf_dir):
    wanted = reads.filter_results(facts(spark, sf_dir), year=1997)
    return reads.total(wanted.where(F.col("category").isin("camera", "senato")))


@query(sql_facts() + """
SELECT f.category AS tipo_elezione, CAST(f.election_date AS VARCHAR) AS data,
       CASE WHEN municipality IS NOT NULL THEN 'comune' WHEN province IS NOT NULL THEN 'provincia'
            WHEN region IS NOT NULL THEN 'regione' WHEN country IS NOT NULL THEN 'nazione'
            ELSE 'nazionale' END AS livello,
       region AS regione, constituency AS circoscrizione, province AS provincia,
       municipality AS comune, country AS nazione, college AS collegio, round AS turno,
       question_number AS numero_quesito, count(*) AS righe,
       count(DISTINCT subject_key) AS soggetti, max(electors) AS elettori,
       max(voters) AS votanti, max(valid_votes) AS voti_validi,
       string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS fonte_file,
       count(DISTINCT source_file) AS file_count, ar.download_url AS fonte_url, ar.sha256
FROM f JOIN ar ON f.category=ar.category AND f.election_date=ar.election_date
WHERE f.category IN ('assemblea_costituente','camera','senato','europee','referendum')
GROUP BY ALL""")
def national_coverage(spark, sf_dir):
    wanted = reads.filter_national(facts(spark, sf_dir))
    return plain(coverage.national_coverage(wanted, archives(spark, sf_dir)))


_REQUESTS_SQL = """
req AS (SELECT DISTINCT region, canonical AS municipality, mkey FROM f
        WHERE region IS NOT NULL AND canonical IS NOT NULL),
rel AS (SELECT req.*, ar.* FROM req CROSS JOIN ar
        WHERE ar.category IN ('assemblea_costituente','camera','senato','europee','referendum')
           OR EXISTS (SELECT 1 FROM f WHERE f.category=ar.category AND f.election_date=ar.election_date
                      AND (lower(f.region)=lower(req.region) OR f.mkey=req.mkey)))
"""
_COVERAGE_SQL = """
SELECT rel.category AS tipo_elezione, CAST(rel.election_date AS VARCHAR) AS data, rel.filename,
       rel.region AS regione, rel.municipality AS comune,
       CASE WHEN coalesce(t.n,0) > 0 THEN 'present'
            WHEN coalesce(m.n,0) = 0 THEN 'not_available_at_municipality_level'
            ELSE 'missing' END AS stato,
       coalesce(t.n,0) AS righe_comune, coalesce(m.n,0) AS righe_livello_comunale,
       rel.download_url AS fonte_url, rel.sha256
FROM rel
LEFT JOIN (SELECT category, election_date, mkey, count(*) n FROM f GROUP BY ALL) t
  ON t.category=rel.category AND t.election_date=rel.election_date AND t.mkey=rel.mkey
LEFT JOIN (SELECT category, election_date, count(municipality) n FROM f GROUP BY ALL) m
  ON m.category=rel.category AND m.election_date=rel.election_date
"""


def _requests(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("region").isNotNull() & F.col("municipality").isNotNull())
        # Labels are few: rows meet before labels are made canonical.
        .select("region", "municipality").distinct()
        .select("region", canonical_municipality(F.col("municipality")).alias("municipality"))
        .distinct()
    )


@query(sql_facts("," + _REQUESTS_SQL) + _COVERAGE_SQL)
def municipality_coverage(spark, sf_dir):
    rows = facts(spark, sf_dir)
    return plain(
        coverage.municipality_coverage(rows, archives(spark, sf_dir), _requests(election_rows(spark, sf_dir)))
    )


@query(sql_facts("," + _REQUESTS_SQL) + f"""
SELECT regione, comune, count(*) AS checked,
       count(*) FILTER (stato='present') AS present, count(*) FILTER (stato='missing') AS missing,
       count(*) FILTER (stato='not_available_at_municipality_level') AS not_available_at_municipality_level
FROM ({_COVERAGE_SQL}) GROUP BY ALL""")
def coverage_summary(spark, sf_dir):
    rows = facts(spark, sf_dir)
    covered = coverage.municipality_coverage(
        rows, archives(spark, sf_dir), _requests(election_rows(spark, sf_dir))
    )
    return coverage.status_tally(
        covered, ["regione", "comune"], ("present", "missing", "not_available_at_municipality_level")
    )


_MUNICIPAL_SQL = """
SELECT CAST(election_date AS VARCHAR) AS data, region AS regione, province AS provincia,
       municipality AS comune, subject AS partito, votes AS voti, round AS turno,
       CAST(NULL AS VARCHAR) AS candidato, seats AS seggi, source_file AS fonte_file,
       source_row AS fonte_riga
FROM f WHERE category='comunali' AND result_type='list' AND municipality IS NOT NULL
"""


@query(sql_facts() + _MUNICIPAL_SQL + " AND (round=1 OR round IS NULL)")
def municipal_party_results(spark, sf_dir):
    return plain(reads.municipal_output(reads.filter_municipal(facts(spark, sf_dir))))


@query(sql_facts() + _MUNICIPAL_SQL)
def municipal_party_results_all_rounds(spark, sf_dir):
    return plain(
        reads.municipal_output(reads.filter_municipal(facts(spark, sf_dir), round_number=None))
    )


@query(sql_facts() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, mkey AS municipality_key,
       municipality AS comune, max(province) AS provincia, max(region) AS regione, count(*) AS rows
FROM f WHERE municipality IS NOT NULL GROUP BY ALL""")
def municipality_list(spark, sf_dir):
    return plain(coverage.municipality_list(facts(spark, sf_dir)))


@query(sql_facts() + """
SELECT municipality AS label, canonical, mkey AS municipality_key, place AS geography_key, count(*) AS n
FROM f WHERE municipality IS NOT NULL GROUP BY ALL""")
def canonical_places(spark, sf_dir):
    # Distinct labels first: the text work then runs once per published label.
    labels = (
        election_rows(spark, sf_dir)
        .where(F.col("municipality").isNotNull())
        .groupBy("municipality", "province", "region", "constituency")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    canonical = canonical_municipality(F.col("municipality"))
    return (
        labels.select(
            F.col("municipality").alias("label"),
            canonical.alias("canonical"),
            slug(canonical).alias("municipality_key"),
            geography_key(
                canonical, F.col("province"), F.col("region"), F.col("constituency")
            ).alias("geography_key"),
            "n",
        )
        .groupBy("label", "canonical", "municipality_key", "geography_key")
        .agg(F.sum("n").alias("n"))
    )


@query(f"""
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT count(*) AS lines, count(DISTINCT k) AS keys, sum(length(k))::BIGINT AS chars FROM (
  SELECT {sql_slug("strip_accents(replace(line, 'ß', 'ss'))")} AS k FROM w)""")
def text_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", "\n")).alias("line")
    )
    keys = lines.select(slug(F.col("line")).alias("k"))
    grouped = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(
        F.sum("n").alias("lines"),
        F.count(F.lit(1)).alias("keys"),
        F.sum(F.col("n") * F.length("k")).cast("bigint").alias("chars"),
    )


def _sql_values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(lit(x) for x in v) + "]"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return ",".join("(" + ",".join(lit(v) for v in row) + ")" for row in rows)


SQL_MAPS = (
    "maps AS (SELECT * FROM (VALUES "
    + _sql_values([(i, *m[:5], m[5]) for i, m in enumerate(reference_data.MAPS)])
    + ") t(position, id, category, start_year, end_year, geography_level, source_ids))"
)


@query(sql_facts("," + SQL_MAPS) + """
SELECT e.category, CAST(e.election_date AS VARCHAR) AS election_date, e.n, maps.id AS map_id,
       coalesce(array_to_string(maps.source_ids, ','), '') AS map_source_ids
FROM (SELECT category, election_date, count(*) AS n FROM f GROUP BY ALL) e
LEFT JOIN maps ON maps.category=e.category AND year(e.election_date) BETWEEN start_year AND end_year""")
def map_version_join(spark, sf_dir):
    elections = election_rows(spark, sf_dir).groupBy("category", "election_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    return plain(maps.with_map_version(elections))


_SQL_LAWS = (
    "laws AS (SELECT * FROM (VALUES "
    + _sql_values([(x[0], x[2]) for x in reference_data.LAWS])
    + ") t(id, citation))"
)


@query(sql_facts("," + SQL_MAPS + "," + _SQL_LAWS) + """
SELECT s.id, s.category, s.source_ids, s.source_citations, e.elections, e.rows FROM (
  SELECT m.position, m.id, m.category, string_agg(u.sid, ',' ORDER BY u.k) AS source_ids,
         string_agg(laws.citation, ',' ORDER BY u.k) AS source_citations
  FROM maps m, LATERAL (SELECT unnest(m.source_ids) AS sid, generate_subscripts(m.source_ids, 1) AS k) u
  JOIN laws ON laws.id = u.sid GROUP BY ALL) s
JOIN maps m ON m.position = s.position
JOIN (SELECT category, year(election_date) AS y, 1 AS one, count(*) AS n FROM f GROUP BY ALL) x
  ON x.category = m.category AND x.y BETWEEN m.start_year AND m.end_year
JOIN LATERAL (SELECT 1) z ON true
JOIN (SELECT mm.position, count(*) AS elections, sum(n)::BIGINT AS rows FROM maps mm
      JOIN (SELECT category, year(election_date) AS y, count(*) AS n FROM f GROUP BY ALL) q
        ON q.category = mm.category AND q.y BETWEEN mm.start_year AND mm.end_year GROUP BY ALL) e
  ON e.position = s.position
GROUP BY ALL""")
def map_sources(spark, sf_dir):
    """Laws behind the maps of the elections in the data, with their volumes."""
    elections = election_rows(spark, sf_dir).groupBy("category", "election_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    used = (
        maps.with_map_version(elections)
        .where(F.col("map_id").isNotNull())
        .groupBy(F.col("map_id").alias("id"), "category")
        .agg(F.count(F.lit(1)).alias("elections"), F.sum("n").alias("rows"))
    )
    cited = maps.map_sources(reference_data.map_versions(spark), reference_data.laws(spark))
    return plain(
        cited.join(used, ["id", "category"]).select(
            "id", "category", "source_ids", "source_citations", "elections", "rows"
        )
    )


@query(sql_facts() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date FROM f
WHERE category IN ('camera','senato') GROUP BY ALL""")
def imported_elections(spark, sf_dir):
    return plain(coverage.imported_elections(facts(spark, sf_dir), fv.AUDIT_CATEGORIES))


@query(sql_facts() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, region, province, constituency,
       municipality, count(*) AS n, sum(votes)::BIGINT AS votes
FROM f WHERE lower(region)='europe' OR lower(constituency)='america 1' GROUP BY ALL""")
def geography_scope(spark, sf_dir):
    """A region scope widened by a constituency."""
    scoped = reads.in_scope(facts(spark, sf_dir), region="Europe", constituency="America 1")
    return plain(
        scoped.groupBy("category", "election_date", "region", "province", "constituency", "municipality")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes"))
    )
