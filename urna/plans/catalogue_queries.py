"""Catalogue, raw-row and compact export queries with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.operators import facts as reads
from urna.plans.election_view import archives, election_rows, facts, sql_facts
from urna.plans.encodings import raw_rows as encoded_rows
from urna.plans.shape import plain
from urna.sinks import exports
from urna.sources import catalogue

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = sql
        return function

    return register


def _listing(spark, sf_dir):
    """The catalogue, with a second archive for each election of an even year."""
    listed = archives(spark, sf_dir).select("category", "election_date", "filename")
    again = listed.where(F.year("election_date") % 2 == 0).withColumn(
        "filename", F.concat(F.lit("bis-"), "filename")
    )
    return listed.unionByName(again).withColumn("year", F.year("election_date"))


_LISTING = """
, li AS (SELECT category, election_date, filename FROM ar UNION ALL
         SELECT category, election_date, concat('bis-', filename) FROM ar WHERE year(election_date) % 2 = 0)
"""


@query(sql_facts(_LISTING) + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, filename FROM li
WHERE category IN ('camera','europee') AND year(election_date) BETWEEN 1993 AND 1997
  AND (category, election_date, filename) NOT IN (SELECT (category, election_date, filename) FROM ar WHERE category='camera')""")
def import_candidates(spark, sf_dir):
    imported = archives(spark, sf_dir).where(F.col("category") == "camera")
    chosen = catalogue.import_candidates(
        _listing(spark, sf_dir), categories=["camera", "europee"], start_year=1993, end_year=1997, imported=imported
    )
    return plain(chosen.select("category", "election_date", "filename"))


@query(sql_facts(_LISTING) + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, filename FROM li
WHERE category='senato' AND year(election_date)=1996""")
def catalogue_entries(spark, sf_dir):
    chosen = catalogue.select_entries(_listing(spark, sf_dir), category="senato", year=1996)
    return plain(chosen.select("category", "election_date", "filename"))


@query(sql_facts(_LISTING) + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, count(*) AS archives
FROM li GROUP BY ALL HAVING count(*) > 1""")
def ambiguous_elections(spark, sf_dir):
    return plain(catalogue.ambiguous_elections(_listing(spark, sf_dir)))


@query(sql_facts(_LISTING) + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, filename FROM li
WHERE (category, election_date) IN (SELECT (category, election_date) FROM f WHERE result_type='candidate' AND round=2)""")
def already_normalised(spark, sf_dir):
    done = facts(spark, sf_dir).where((F.col("result_type") == "candidate") & (F.col("round") == 2))
    found = catalogue.already_normalised(_listing(spark, sf_dir), done)
    return plain(found.select("category", "election_date", "filename"))


@query(sql_facts() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, source_file AS file_name, source_row AS row_number
FROM f WHERE category='camera' AND year(election_date)=1996 AND mkey='roma'""")
def raw_rows(spark, sf_dir):
    """Rows as imported, of one archive and municipality, with where they come from."""
    found = reads.filter_raw(
        encoded_rows(election_rows(spark, sf_dir)),
        category="camera", election_date=dt.date(1996, 1, 1), municipality="Roma",
    )
    return plain(found.where(F.size("payload") > 0).select("_meta.*"))


@query(sql_facts() + """
SELECT concat_ws(';', CAST(election_date AS VARCHAR), municipality, subject, CAST(votes AS VARCHAR)) AS line
FROM f WHERE category='comunali' AND result_type='list' AND municipality IS NOT NULL AND (round=1 OR round IS NULL)""")
def csv_export_compact(spark, sf_dir):
    rows = reads.municipal_output(reads.filter_municipal(facts(spark, sf_dir)))
    return exports.export_lines(rows, fv.MUNICIPAL_COMPACT_COLUMNS)
