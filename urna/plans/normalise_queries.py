"""Normaliser queries: the election view is encoded, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from urna.functions.numbers import parts_per_million
from urna.operators import normalise
from urna.plans.election_view import election_rows, sql_facts, sql_slug
from urna.plans.encodings import raw_rows
from urna.plans.shape import plain, sql_ppm

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _in_ppm(df):
    votes = F.coalesce(
        F.nullif(F.col("valid_list_votes"), F.lit(0).cast("bigint")), F.col("valid_votes")
    )
    return plain(
        df.withColumn("percentage_ppm", parts_per_million(F.col("votes"), votes))
        .withColumn("turnout_ppm", parts_per_million(F.col("voters"), F.col("electors")))
        .select(
            "archive", "round", "region", "constituency", "province", "municipality",
            "municipality_key", "country", "college", "question_number", "result_type", "subject",
            "subject_key", "party", "candidate", "option", "votes", "percentage_ppm", "seats",
            "electors", "voters", "turnout_ppm", "valid_votes", "valid_list_votes",
            "blank_ballots", "source_file", "source_row",
        )
    )


# First known figures per context, in row order (file, row).
_KEYS = "category, election_date, region, constituency, province, mkey, country, college, round, qn"
_SUMMARY = f"""
k AS (SELECT *, CASE WHEN category='referendum' THEN coalesce(question_number,'1') ELSE question_number END AS qn,
             concat(category,'-',CAST(year(election_date) AS VARCHAR)) AS archive FROM f),
s AS (SELECT {_KEYS},
        arg_min(electors, (source_file, source_row)) FILTER (electors IS NOT NULL) AS s_electors,
        arg_min(voters, (source_file, source_row)) AS s_voters,
        arg_min(valid_votes, (source_file, source_row)) AS s_valid,
        arg_min(blank_ballots, (source_file, source_row)) AS s_blank,
        arg_min(electors, (source_file, source_row)) FILTER (electors IS NOT NULL) AS t_electors,
        arg_min(voters, (source_file, source_row)) FILTER (electors IS NOT NULL) AS t_voters
      FROM k GROUP BY ALL),
j AS (SELECT k.*, s.s_electors, s.s_voters, s.s_valid, s.s_blank FROM k JOIN s ON
      k.category=s.category AND k.election_date=s.election_date
      AND k.region IS NOT DISTINCT FROM s.region AND k.constituency IS NOT DISTINCT FROM s.constituency
      AND k.province IS NOT DISTINCT FROM s.province AND k.mkey IS NOT DISTINCT FROM s.mkey
      AND k.country IS NOT DISTINCT FROM s.country AND k.college IS NOT DISTINCT FROM s.college
      AND k.round IS NOT DISTINCT FROM s.round AND k.qn IS NOT DISTINCT FROM s.qn)
"""
_FROM_ER = f"""
SELECT archive, round, region, constituency, province, canonical AS municipality,
       mkey AS municipality_key, country, college, qn AS question_number, result_type,
       CASE WHEN result_type='list' THEN subject ELSE replace(subject,'#',' ') END AS subject,
       {sql_slug('subject')} AS subject_key,
       CASE WHEN result_type='list' THEN subject END AS party,
       CASE WHEN result_type<>'list' THEN replace(subject,'#',' ') END AS candidate,
       CAST(NULL AS VARCHAR) AS option, votes, {sql_ppm('votes','s_valid')} AS percentage_ppm, seats,
       s_electors AS electors, s_voters AS voters, {sql_ppm('s_voters','s_electors')} AS turnout_ppm,
       s_valid AS valid_votes, CAST(NULL AS BIGINT) AS valid_list_votes, s_blank AS blank_ballots,
       source_file, source_row
FROM j WHERE category <> 'referendum'
"""
_OPTIONS = f"""
SELECT archive, round, region, constituency, province, canonical AS municipality,
       mkey AS municipality_key, country, college, qn AS question_number, 'option' AS result_type,
       o.option AS subject, lower(o.option) AS subject_key, CAST(NULL AS VARCHAR) AS party,
       CAST(NULL AS VARCHAR) AS candidate, o.option AS option, o.v AS votes,
       {sql_ppm('o.v','s_valid')} AS percentage_ppm, seats, s_electors AS electors,
       s_voters AS voters, {sql_ppm('s_voters','s_electors')} AS turnout_ppm, s_valid AS valid_votes,
       CAST(NULL AS BIGINT) AS valid_list_votes, s_blank AS blank_ballots, source_file, source_row
FROM (SELECT *, unnest([{{'option':'SI','v':votes}}, {{'option':'NO','v':s_valid-votes}}]) AS o
      FROM j WHERE category='referendum') WHERE o.v >= 0
"""


@query(sql_facts("," + _SUMMARY) + _FROM_ER + " UNION ALL " + _OPTIONS)
def normalise_history(spark, sf_dir):
    return _in_ppm(normalise.normalise(raw_rows(election_rows(spark, sf_dir, keyed=True))))


@query(sql_facts("," + _SUMMARY) + _OPTIONS)
def referendum_options(spark, sf_dir):
    er = election_rows(spark, sf_dir, keyed=True).where(F.col("category") == "referendum")
    return _in_ppm(normalise.normalise(raw_rows(er)))


_SECTION_SQL = f"""
k AS (SELECT *, concat(category,'-',CAST(year(election_date) AS VARCHAR)) AS archive,
             CASE WHEN category='referendum' THEN coalesce(question_number,'1') ELSE question_number END AS qn FROM f),
g1 AS (SELECT {_KEYS}, section,
        arg_min(electors, (source_file, source_row)) FILTER (electors IS NOT NULL) AS electors,
        arg_min(voters, (source_file, source_row)) AS voters,
        arg_min(valid_votes, (source_file, source_row)) AS valid_votes,
        arg_min(blank_ballots, (source_file, source_row)) AS blank_ballots
      FROM k GROUP BY ALL),
g2 AS (SELECT {_KEYS}, sum(electors)::BIGINT AS electors, sum(voters)::BIGINT AS voters,
        sum(valid_votes)::BIGINT AS valid_votes, sum(blank_ballots)::BIGINT AS blank_ballots
      FROM g1 GROUP BY ALL),
x AS (SELECT archive, canonical, {_KEYS}, result_type, CASE WHEN result_type='list' THEN subject ELSE replace(subject,'#',' ') END AS subject,
             votes, seats, source_file, source_row FROM k WHERE category<>'referendum'
      UNION ALL
      -- NO is derived row by row from the row's own valid votes.
      SELECT archive, canonical, {_KEYS}, 'option', o.option, o.v, seats, source_file, source_row
      FROM (SELECT *, unnest([{{'option':'SI','v':votes}}, {{'option':'NO','v':valid_votes-votes}}]) AS o FROM k WHERE category='referendum')
      WHERE o.v >= 0),
v AS (SELECT archive, arg_min(canonical, (source_file, source_row)) AS canonical, {_KEYS}, result_type, subject, sum(votes)::BIGINT AS votes,
        arg_min(seats, (source_file, source_row)) AS seats,
        arg_min(source_file, (source_file, source_row)) AS source_file
      FROM x GROUP BY archive, {_KEYS}, result_type, subject),
lt AS (SELECT {_KEYS}, sum(votes)::BIGINT AS list_votes FROM x WHERE result_type='list' GROUP BY ALL),
j AS (SELECT v.*, g2.electors, g2.voters, g2.valid_votes, g2.blank_ballots, lt.list_votes
      FROM v JOIN g2 ON v.category=g2.category AND v.election_date=g2.election_date
      AND v.region IS NOT DISTINCT FROM g2.region AND v.constituency IS NOT DISTINCT FROM g2.constituency
      AND v.province IS NOT DISTINCT FROM g2.province AND v.mkey IS NOT DISTINCT FROM g2.mkey
      AND v.country IS NOT DISTINCT FROM g2.country AND v.college IS NOT DISTINCT FROM g2.college
      AND v.round IS NOT DISTINCT FROM g2.round AND v.qn IS NOT DISTINCT FROM g2.qn
      LEFT JOIN lt ON v.category=lt.category AND v.election_date=lt.election_date
      AND v.region IS NOT DISTINCT FROM lt.region AND v.constituency IS NOT DISTINCT FROM lt.constituency
      AND v.province IS NOT DISTINCT FROM lt.province AND v.mkey IS NOT DISTINCT FROM lt.mkey
      AND v.country IS NOT DISTINCT FROM lt.country AND v.college IS NOT DISTINCT FROM lt.college
      AND v.round IS NOT DISTINCT FROM lt.round AND v.qn IS NOT DISTINCT FROM lt.qn)
"""


@query(sql_facts("," + _SECTION_SQL) + f"""
SELECT archive, round, region, constituency, province, canonical AS municipality,
       mkey AS municipality_key, country, college, qn AS question_number, result_type, subject,
       {sql_slug('subject')} AS subject_key,
       CASE WHEN result_type='list' THEN subject END AS party,
       CASE WHEN result_type='candidate' THEN subject END AS candidate,
       CASE WHEN result_type='option' THEN subject END AS option, votes,
       {sql_ppm('votes','coalesce(nullif(list_votes,0),valid_votes)')} AS percentage_ppm, seats,
       electors, voters, {sql_ppm('voters','electors')} AS turnout_ppm, valid_votes,
       list_votes AS valid_list_votes, blank_ballots,
       concat(source_file,'#municipality-aggregate') AS source_file, CAST(0 AS BIGINT) AS source_row
FROM j""")
def normalise_sections(spark, sf_dir):
    return _in_ppm(normalise.normalise(raw_rows(election_rows(spark, sf_dir, keyed=True), sections=True)))


@query(sql_facts() + """
SELECT concat(category,'-',CAST(year(election_date) AS VARCHAR)) AS archive, region, province,
       canonical AS municipality, mkey AS municipality_key, subject AS party, subject_key AS party_key,
       votes, round, CAST(NULL AS VARCHAR) AS candidate, seats, source_file, source_row
FROM f WHERE category='comunali' AND result_type='list' AND canonical IS NOT NULL""")
def municipal_only(spark, sf_dir):
    er = election_rows(spark, sf_dir, keyed=True).where(F.col("category") == "comunali")
    return plain(normalise.municipal_only(raw_rows(er)).drop("category", "election_date"))
