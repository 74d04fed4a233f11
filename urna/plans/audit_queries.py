"""Reconstruction and audit queries, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.numbers import parts_per_million
from urna.functions.text import canonical_municipality
from urna.operators import audit, layers
from urna.plans.election_view import facts, sql_facts, stored_facts
from urna.plans.facts_queries import SQL_MAPS
from urna.plans.shape import plain, sql_ppm
from urna.session import stage

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def place_layers(spark, sf_dir) -> DataFrame:
    return layers.layers(layers.fragment_units(layers.with_keys(facts(spark, sf_dir, keyed=True))))


UNITS_SQL = """
u AS (SELECT place, category, election_date, source_file, result_type, round, municipality AS label,
             coalesce(college,'') AS college, coalesce(constituency,'') AS constituency,
             max(electors) AS electors, max(voters) AS voters, sum(votes)::BIGINT AS votes
      FROM f WHERE municipality IS NOT NULL GROUP BY ALL),
l AS (SELECT place, category, election_date, source_file, result_type, round, count(*) AS parts,
             CASE WHEN count(electors)=count(*) THEN sum(electors)::BIGINT END AS electors,
             CASE WHEN count(voters)=count(*) THEN sum(voters)::BIGINT END AS voters,
             sum(votes)::BIGINT AS votes
      FROM u GROUP BY ALL),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY place, category, election_date
        ORDER BY electors IS NULL, result_type<>'list', voters IS NULL, votes DESC, source_file,
                 result_type, round NULLS FIRST) = 1),
w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY place, category, election_date
        ORDER BY coalesce(round=1,false) DESC, round IS NOT NULL, electors IS NULL,
                 result_type<>'list', voters IS NULL, votes DESC, source_file, result_type,
                 round NULLS FIRST) = 1)
"""
_LAYER = (
    "SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, source_file, "
    "result_type, round, parts, electors, voters, votes FROM "
)


@query(sql_facts("," + UNITS_SQL) + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, source_file, result_type,
       round, label, college, constituency, electors, voters, votes FROM u""")
def fragment_units(spark, sf_dir):
    return plain(layers.fragment_units(layers.with_keys(facts(spark, sf_dir, keyed=True))).drop("archive"))


@query(sql_facts("," + UNITS_SQL) + _LAYER + "l")
def municipality_layers(spark, sf_dir):
    return plain(place_layers(spark, sf_dir).drop("archive"))


@query(sql_facts("," + UNITS_SQL) + _LAYER + "b")
def best_layer(spark, sf_dir):
    return plain(layers.best_layer(place_layers(spark, sf_dir)).drop("archive"))


@query(sql_facts("," + UNITS_SQL) + _LAYER + "w")
def verification_layer(spark, sf_dir):
    return plain(layers.verification_layer(place_layers(spark, sf_dir)).drop("archive"))


TOTALS_SQL = """
t AS (SELECT f.place, f.category, f.election_date, f.source_file, f.result_type, w.round AS layer_round,
             subject_key, sum(f.votes)::BIGINT AS votes, count(*) AS parts, min(subject) AS subject
      FROM f JOIN w ON f.place=w.place AND f.category=w.category AND f.election_date=w.election_date
       AND f.source_file=w.source_file AND f.result_type=w.result_type
       AND (w.round IS NULL OR f.round=w.round)
      WHERE f.municipality IS NOT NULL GROUP BY ALL)
"""


@query(sql_facts("," + UNITS_SQL + "," + TOTALS_SQL) + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, source_file, result_type,
       layer_round, subject_key, votes, parts, subject FROM t""")
def subject_totals(spark, sf_dir):
    placed = stored_facts(spark, sf_dir)
    chosen = layers.verification_layer(layers.layers(layers.fragment_units(placed)))
    return plain(layers.subject_totals(layers.subject_units(placed), chosen))


@query(sql_facts() + """
, req AS (SELECT DISTINCT concat('q:', canonical, '|', region, '|', constituency) AS place, mkey, region, constituency
          FROM f WHERE region IS NOT NULL AND canonical IS NOT NULL),
m AS (SELECT req.place, f.category, f.election_date, f.source_file, f.result_type, f.round,
             f.municipality AS label, f.college, f.constituency, max(electors) AS electors,
             max(voters) AS voters, sum(votes)::BIGINT AS votes
      FROM f JOIN req ON f.mkey=req.mkey AND (f.region=req.region OR f.constituency=req.constituency)
      GROUP BY ALL)
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, source_file, result_type, round,
       count(*) AS parts, CASE WHEN count(electors)=count(*) THEN sum(electors)::BIGINT END AS electors,
       CASE WHEN count(voters)=count(*) THEN sum(voters)::BIGINT END AS voters, sum(votes)::BIGINT AS votes
FROM m GROUP BY ALL""")
def requested_layers(spark, sf_dir):
    """Layers of a table of requests: a region widened by a constituency."""
    rows = facts(spark, sf_dir)
    canonical = canonical_municipality(F.col("municipality"))
    requests = (
        rows.where(F.col("region").isNotNull() & F.col("municipality").isNotNull())
        .select(
            F.concat(F.lit("q:"), canonical, F.lit("|"), "region", F.lit("|"), "constituency").alias("place"),
            canonical.alias("municipality"),
            F.lit(None).cast("string").alias("province"),
            "region",
            "constituency",
        )
        .distinct()
    )
    units = layers.requested_units(layers.geography_units(rows), requests)
    return plain(layers.layers(units).drop("archive"))


def stored_verifications(best: DataFrame) -> DataFrame:
    """Verifications derived from every layer: complete for some votes, partial for others.

    A share of them is filed under the bare key of older stores.
    """
    bare = F.substring_index("place", "|", -1)
    old = F.col("votes") % 5 == 0
    source = F.regexp_extract("place", r"^.:([^|]*)\|", 1)
    return best.select(
        F.when(old & F.col("place").startswith("p:"), bare).otherwise(F.col("place")).alias("verification_key"),
        "category", "election_date",
        F.when(F.col("votes") % 3 == 0, "exact_match").otherwise("mismatch").alias("status"),
        (F.col("votes") % 3 == 0).alias("complete_set"),
        (F.col("votes") % 4 + 1).alias("official_pages"),
        (F.col("electors") + 50).alias("official_electors"),
        F.when(F.col("votes") % 7 != 0, F.col("voters") + 30).alias("official_voters"),
        (F.col("votes") + 10).alias("official_valid_votes"),
        F.array(F.concat(F.lit("https://elezionistorico.interno.gov.it/?k="), "place")).alias("source_urls"),
        F.timestamp_seconds(F.col("votes") * 100000 + F.coalesce("electors", F.lit(0))).alias("verified_at"),
        F.when(F.col("place").startswith("p:"), source).alias("source_province"),
        F.when(F.col("place").startswith("r:"), source).alias("source_region"),
    )


def audited(spark, sf_dir) -> DataFrame:
    placed = stored_facts(spark, sf_dir).where(F.col("category").isin(*fv.AUDIT_CATEGORIES))
    best = stage(layers.best_layer(layers.layers(layers.fragment_units(placed))))
    places = placed.where(F.col("municipality").isNotNull()).select(
        "place", "municipality_key", "province", "region",
        F.when(F.col("place").startswith("c:"), F.col("constituency")).alias("constituency"),
    ).distinct()
    newest = audit.newest_verification(places, stored_verifications(best))
    return audit.temporal_audit(audit.overlay(best, newest))


_VERIFIED = """
ver AS (SELECT CASE WHEN votes % 5 = 0 AND place LIKE 'p:%' THEN split_part(place,'|',2) ELSE place END AS vkey,
               place AS vplace, category, election_date, votes, electors + 50 AS oe,
               CASE WHEN votes % 7 <> 0 THEN voters + 30 END AS ov, votes + 10 AS on_, votes % 3 = 0 AS complete,
               CASE WHEN votes % 3 = 0 THEN 'exact_match' ELSE 'mismatch' END AS vstatus
        FROM b),
nv AS (SELECT b.place, ver.* EXCLUDE (vplace) FROM b JOIN ver
       ON ver.category=b.category AND ver.election_date=b.election_date
       AND (ver.vkey = b.place OR (ver.vkey = split_part(b.place,'|',2) AND left(ver.vplace,2)='p:'
            AND (left(b.place,2)='c:' OR split_part(ver.vplace,'|',1) = split_part(b.place,'|',1))))
       QUALIFY row_number() OVER (PARTITION BY b.place, ver.category, ver.election_date ORDER BY ver.votes*100000+coalesce(ver.oe-50,0) DESC, vkey DESC) = 1),
o AS (SELECT b.place, b.category, b.election_date, b.source_file, b.result_type, b.round, b.parts,
             CASE WHEN complete THEN coalesce(oe, b.electors) ELSE b.electors END AS electors,
             CASE WHEN complete THEN coalesce(ov, b.voters) ELSE b.voters END AS voters,
             CASE WHEN complete THEN coalesce(on_, b.votes) ELSE b.votes END AS votes,
             CASE WHEN complete THEN 'official_municipality_pages' ELSE 'open_data' END AS fonte_aggregazione,
             CASE WHEN complete THEN b.electors END AS electors_open_data,
             CASE WHEN complete THEN b.voters END AS voters_open_data,
             CASE WHEN complete THEN b.votes END AS votes_open_data, vstatus AS verifica_ufficiale_stato
      FROM b LEFT JOIN nv ON nv.place=b.place AND nv.category=b.category AND nv.election_date=b.election_date
      WHERE b.category IN ('camera','senato'))
"""
_AUDIT = f"""
n AS (SELECT o.*,
   last_value(CASE WHEN electors<>0 THEN {{'d':election_date,'v':electors}} END IGNORE NULLS) OVER p AS pe,
   first_value(CASE WHEN electors<>0 THEN {{'d':election_date,'v':electors}} END IGNORE NULLS) OVER q AS ne,
   last_value(CASE WHEN voters<>0 THEN {{'d':election_date,'v':voters}} END IGNORE NULLS) OVER p AS pv,
   first_value(CASE WHEN voters<>0 THEN {{'d':election_date,'v':voters}} END IGNORE NULLS) OVER q AS nx
   FROM o WINDOW p AS (PARTITION BY place, category ORDER BY election_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 q AS (PARTITION BY place, category ORDER BY election_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT n.*, x.category AS oc, x.electors AS oe2, x.voters AS ov2,
        CASE WHEN x.electors<>0 THEN election_date
             WHEN pe IS NOT NULL AND (ne IS NULL OR date_diff('day',pe.d,n.election_date) <= date_diff('day',n.election_date,ne.d)) THEN pe.d
             ELSE ne.d END AS ref_d,
        CASE WHEN x.electors<>0 THEN x.electors
             WHEN pe IS NOT NULL AND (ne IS NULL OR date_diff('day',pe.d,n.election_date) <= date_diff('day',n.election_date,ne.d)) THEN pe.v
             ELSE ne.v END AS ref_e,
        CASE WHEN x.electors<>0 THEN x.category WHEN pe IS NOT NULL OR ne IS NOT NULL THEN n.category END AS ref_c,
        coalesce(x.voters<>0,false) AS same_v
      FROM n LEFT JOIN (SELECT place, category, election_date, electors, voters FROM o) x
        USING (place, election_date) WHERE x.category IS DISTINCT FROM n.category OR x.category IS NULL
      ),
r1 AS (SELECT * FROM r UNION ALL
       SELECT n.*, NULL, NULL, NULL,
        CASE WHEN pe IS NOT NULL AND (ne IS NULL OR date_diff('day',pe.d,n.election_date) <= date_diff('day',n.election_date,ne.d)) THEN pe.d ELSE ne.d END,
        CASE WHEN pe IS NOT NULL AND (ne IS NULL OR date_diff('day',pe.d,n.election_date) <= date_diff('day',n.election_date,ne.d)) THEN pe.v ELSE ne.v END,
        CASE WHEN pe IS NOT NULL OR ne IS NOT NULL THEN n.category END, false
       FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.place=n.place AND r.category=n.category AND r.election_date=n.election_date)),
z AS (SELECT *, CASE WHEN same_v THEN ov2 END AS sv, CASE WHEN NOT same_v THEN pv.d END AS pd,
        CASE WHEN NOT same_v THEN pv.v END AS pvv, CASE WHEN NOT same_v THEN nx.d END AS nd,
        CASE WHEN NOT same_v THEN nx.v END AS nvv FROM r1),
y AS (SELECT *, round(nullif(voters,0)*1.0e0/sv,6) AS r0, round(nullif(voters,0)*1.0e0/pvv,6) AS r_1,
        round(nullif(voters,0)*1.0e0/nvv,6) AS r_2, round(electors*1.0e0/ref_e,6) AS re,
        round(votes*1.0e0/nullif(electors,0),6) AS rv FROM z),
a AS (SELECT *, CASE
   WHEN (electors<>0 AND votes > electors*1.02e0) OR (electors<>0 AND voters > electors*1.01e0) OR votes > voters*1.02e0 THEN 'invalid'
   WHEN coalesce(electors,0)=0 OR coalesce(voters,0)=0 OR coalesce(r0,r_1,r_2) IS NULL THEN 'insufficient_data'
   WHEN NOT (rv BETWEEN 0.2e0 AND 1.02e0) OR NOT coalesce(re BETWEEN 0.65e0 AND 1.35e0, true)
     OR NOT coalesce(r0 BETWEEN 0.65e0 AND 1.35e0, true) OR NOT coalesce(r_1 BETWEEN 0.65e0 AND 1.35e0, true)
     OR NOT coalesce(r_2 BETWEEN 0.65e0 AND 1.35e0, true) THEN 'warning' ELSE 'pass' END AS stato FROM y)
"""


@query(sql_facts("," + UNITS_SQL + "," + _VERIFIED + "," + _AUDIT + "," + SQL_MAPS) + f"""
SELECT a.place, a.category, CAST(a.election_date AS VARCHAR) AS election_date, a.source_file, a.result_type,
       a.round, a.parts, a.electors, a.voters, a.votes, fonte_aggregazione, electors_open_data,
       voters_open_data, votes_open_data, verifica_ufficiale_stato,
       CAST(ref_d AS VARCHAR) AS data_riferimento, ref_c AS tipo_elezione_riferimento,
       ref_e AS aventi_diritto_riferimento, {sql_ppm('a.electors','ref_e')} AS rapporto_riferimento_ppm,
       sv AS votanti_stessa_data, CAST(pd AS VARCHAR) AS data_precedente, pvv AS votanti_precedenti,
       CAST(nd AS VARCHAR) AS data_successiva, nvv AS votanti_successivi,
       maps.id AS mappa_collegi_versione, maps.source_ids[1] AS fonte_confini_id, a.stato
FROM a LEFT JOIN maps ON maps.category=a.category AND year(a.election_date) BETWEEN start_year AND end_year""")
def temporal_audit(spark, sf_dir):
    rows = audited(spark, sf_dir).withColumn(
        "rapporto_riferimento_ppm",
        parts_per_million(F.col("electors"), F.col("aventi_diritto_riferimento")),
    )
    return plain(
        rows.select(
            "place", "category", "election_date", "source_file", "result_type", "round", "parts",
            "electors", "voters", "votes", "fonte_aggregazione", "electors_open_data",
            "voters_open_data", "votes_open_data", "verifica_ufficiale_stato", "data_riferimento",
            "tipo_elezione_riferimento", "aventi_diritto_riferimento", "rapporto_riferimento_ppm",
            "votanti_stessa_data", "data_precedente", "votanti_precedenti", "data_successiva",
            "votanti_successivi", "mappa_collegi_versione", "fonte_confini_id", "stato",
        )
    )


@query(sql_facts("," + UNITS_SQL + "," + _VERIFIED + "," + _AUDIT) + """
SELECT category, count(*) AS checked, count(*) FILTER (stato='pass') AS pass,
       count(*) FILTER (stato='warning') AS warning, count(*) FILTER (stato='invalid') AS invalid,
       count(*) FILTER (stato='insufficient_data') AS insufficient_data
FROM a GROUP BY ALL""")
def audit_summary(spark, sf_dir):
    return audit.audit_summary(audited(spark, sf_dir), ["category"])
