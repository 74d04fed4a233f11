"""Verification, closure and completeness queries, each with its SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.functions.text import canonical_municipality, slug
from urna.operators import closure, layers, verify
from urna.plans.audit_queries import TOTALS_SQL, UNITS_SQL
from urna.plans.election_view import facts, sql_facts, stored_facts
from urna.plans.shape import plain
from urna.session import stage

QUERIES, ORACLE = {}, {}
TOLERANCE = 0.002


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def official_pages(rows: DataFrame) -> DataFrame:
    """Two pages per place and election, rendered from the reconstruction.

    Some subjects gain a vote and some are left out; the camera prints totals.
    """
    placed = layers.with_keys(rows)
    chosen = layers.verification_layer(layers.layers(layers.fragment_units(placed)))
    totals = layers.subject_totals(layers.subject_units(placed), chosen)
    changed = totals.where(F.col("votes") % 29 != 0).withColumn(
        "votes",
        F.col("votes")
        + F.when((F.col("votes") + F.length("subject_key") * 7) % 23 == 0, 1).otherwise(0),
    )

    def halves(column: str):
        first = F.floor(F.col(column) / 2).cast("bigint")
        return F.array(
            F.struct(F.lit(1).alias("part"), first.alias("value")),
            F.struct(F.lit(2).alias("part"), (F.col(column) - first).alias("value")),
        )

    keys = [*verify.SET, "part"]
    records = changed.withColumn("h", F.explode(halves("votes"))).select(
        *verify.SET, "h.part", "result_type", "subject", F.col("h.value").alias("votes"), "layer_round"
    )
    null_id = F.lit(None).cast("double")
    # At most one record per subject of a page.
    listed = records.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("subject").alias("name"), F.col("result_type").alias("record_type"),
                    F.when(F.col("layer_round") == 1, 1).cast("bigint").alias("round"), "votes",
                )
            )
        ).alias("named"),
        F.sum("votes").alias("total"),
    )
    kind = (
        "array<struct<position:int,record_type:string,name:string,round:bigint,votes:bigint,"
        "percentage:double,seats:bigint>>"
    )
    null_seats = F.lit(None).cast("bigint")
    body = F.transform(
        "named",
        lambda r, i: F.struct(
            i.alias("position"), r["record_type"].alias("record_type"), r["name"].alias("name"),
            r["round"].alias("round"), r["votes"].alias("votes"), null_id.alias("percentage"),
            null_seats.alias("seats"),
        ),
    )
    printed = F.array(
        F.struct(
            F.lit(999).alias("position"), F.lit("total").alias("record_type"),
            F.lit("TOTALI").alias("name"), null_seats.alias("round"),
            (F.col("total") + F.when(F.col("total") % 3 == 0, 1).otherwise(0)).alias("votes"),
            null_id.alias("percentage"), null_seats.alias("seats"),
        )
    )
    written = listed.withColumn(
        "records", F.when(F.col("category") == "camera", F.concat(body, printed)).otherwise(body)
    ).select(*keys, "records")
    scope = placed.where(F.col("municipality").isNotNull()).groupBy(*verify.SET).agg(
        F.max(canonical_municipality(F.col("municipality"))).alias("municipality"),
        F.max(F.when(F.col("place").startswith("p:"), F.col("province"))).alias("province"),
        F.max(F.when(F.col("place").startswith("r:"), F.col("region"))).alias("region"),
        F.max(F.when(F.col("place").startswith("c:"), F.col("constituency"))).alias("constituency"),
    )
    measured = chosen.select(
        *verify.SET,
        F.explode(
            F.arrays_zip(halves("electors").alias("e"), halves("voters").alias("v"))
        ).alias("z"),
    ).select(
        *verify.SET, F.col("z.e.part").alias("part"),
        F.col("z.e.value").alias("electors"), F.col("z.v.value").alias("voters"),
    )
    return (
        measured.join(scope, list(verify.SET))
        .join(written, keys, "left")
        .withColumn("records", F.coalesce("records", F.array().cast(kind)))
        .withColumn("url", F.concat_ws("/", "category", F.col("election_date").cast("string"), "place", F.col("part").cast("string")))
        .withColumn("college_code", F.col("part").cast("string"))
    )


_LOCAL = """
st AS (SELECT place, category, election_date, mkey, max(CASE WHEN place LIKE 'p:%' THEN province END) AS sp,
              max(CASE WHEN place LIKE 'r:%' THEN region END) AS sr,
              max(CASE WHEN place LIKE 'c:%' THEN constituency END) AS sc
       FROM f WHERE place IS NOT NULL GROUP BY ALL),
sf AS (SELECT st.place AS splace, f.* FROM f JOIN st ON f.category=st.category
       AND f.election_date=st.election_date AND f.mkey=st.mkey
       AND CASE WHEN sp IS NOT NULL THEN f.province=sp WHEN sr IS NOT NULL THEN f.region=sr ELSE f.constituency=sc END),
lu AS (SELECT splace, category, election_date, source_file, result_type, round, municipality, college, constituency,
              max(electors) AS electors, max(voters) AS voters, sum(votes)::BIGINT AS votes FROM sf GROUP BY ALL),
ll AS (SELECT splace, category, election_date, source_file, result_type, round, count(*) AS parts,
              CASE WHEN count(electors)=count(*) THEN sum(electors)::BIGINT END AS electors,
              CASE WHEN count(voters)=count(*) THEN sum(voters)::BIGINT END AS voters,
              sum(votes)::BIGINT AS votes FROM lu GROUP BY ALL),
lw AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY splace, category, election_date
        ORDER BY coalesce(round=1,false) DESC, round IS NOT NULL, electors IS NULL, result_type<>'list',
                 voters IS NULL, votes DESC, source_file, result_type, round NULLS FIRST) = 1),
lt AS (SELECT sf.splace, sf.category, sf.election_date, subject_key, sum(sf.votes)::BIGINT AS votes, min(subject) AS subject
       FROM sf JOIN lw ON sf.splace=lw.splace AND sf.category=lw.category AND sf.election_date=lw.election_date
        AND sf.source_file=lw.source_file AND sf.result_type=lw.result_type AND (lw.round IS NULL OR sf.round=lw.round)
       GROUP BY ALL),
off AS (SELECT place, category, election_date, result_type, subject_key, subject,
               votes + CASE WHEN (votes + length(subject_key)*7) % 23 = 0 THEN 1 ELSE 0 END AS votes
        FROM t WHERE votes % 29 <> 0),
ov AS (SELECT w.place, w.category, w.election_date, w.electors AS oe, w.voters AS ovt,
              coalesce(CASE WHEN w.category='camera' THEN x.printed ELSE x.plain END, 0) AS valid
       FROM w LEFT JOIN (SELECT place, category, election_date, sum(votes)::BIGINT AS plain,
              (sum(votes//2) + CASE WHEN sum(votes//2) % 3 = 0 THEN 1 ELSE 0 END
               + sum(votes-votes//2) + CASE WHEN sum(votes-votes//2) % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS printed
              FROM off GROUP BY ALL) x USING (place, category, election_date)),
vf AS (SELECT ov.place, ov.category, ov.election_date, c.campo, c.ufficiale, c.ricostruito,
              c.ricostruito - c.ufficiale AS scarto,
              CASE WHEN c.ufficiale IS NULL OR c.ricostruito IS NULL THEN NULL
                   WHEN c.ufficiale <> 0 THEN abs(c.ricostruito-c.ufficiale)*1.0e0/c.ufficiale <= 0.002e0
                   ELSE c.ricostruito = c.ufficiale END AS coincide
       FROM (SELECT ov.*, lw.electors AS le, lw.voters AS lv, lw.votes AS lvo FROM ov LEFT JOIN lw
             ON lw.splace=ov.place AND lw.category=ov.category AND lw.election_date=ov.election_date) ov,
       LATERAL (SELECT unnest(['aventi_diritto','votanti','voti_validi']) AS campo,
                       unnest([oe, ovt, valid]) AS ufficiale, unnest([le, lv, lvo]) AS ricostruito) c),
ks AS (SELECT off.* FROM off JOIN lw ON lw.splace=off.place AND lw.category=off.category
       AND lw.election_date=off.election_date AND off.result_type=lw.result_type),
vs AS (SELECT coalesce(ks.place, lt.splace) AS place, coalesce(ks.category, lt.category) AS category,
              coalesce(ks.election_date, lt.election_date) AS election_date,
              coalesce(ks.subject_key, lt.subject_key) AS subject_key, ks.subject AS partito_ufficiale,
              lt.subject AS partito_ricostruito, ks.votes AS voti_ufficiali, lt.votes AS voti_ricostruiti,
              lt.votes - ks.votes AS scarto,
              CASE WHEN ks.votes IS NULL THEN 'missing_official' WHEN lt.votes IS NULL THEN 'missing_local'
                   WHEN ks.votes = lt.votes THEN 'match'
                   WHEN (CASE WHEN ks.votes<>0 THEN abs(lt.votes-ks.votes)*1.0e0/ks.votes ELSE 1 END) <= 0.002e0 THEN 'within_tolerance'
                   ELSE 'mismatch' END AS stato
       FROM ks FULL OUTER JOIN lt ON lt.splace=ks.place AND lt.category=ks.category
        AND lt.election_date=ks.election_date AND lt.subject_key=ks.subject_key),
vt AS (SELECT st.place, st.category, st.election_date, count(vs.stato) AS partiti_confrontati,
              count(*) FILTER (vs.stato IN ('match','within_tolerance')) AS partiti_coincidenti,
              count(*) FILTER (vs.stato IN ('mismatch','missing_local','missing_official')) AS partiti_non_coincidenti,
              count(*) FILTER (vs.stato = 'within_tolerance') AS tol
       FROM st LEFT JOIN vs USING (place, category, election_date) GROUP BY ALL),
vo AS (SELECT vt.*, lw.parts AS pezzi_open_data,
              CASE WHEN lw.parts IS NULL THEN 'local_data_missing'
                   WHEN partiti_non_coincidenti>0 OR g.apart>0 THEN 'mismatch'
                   WHEN tol>0 OR g.moved>0 THEN 'within_tolerance' ELSE 'exact_match' END AS stato
       FROM vt JOIN (SELECT place, category, election_date, count(*) FILTER (NOT coincide) AS apart,
                            count(*) FILTER (scarto<>0) AS moved FROM vf GROUP BY ALL) g USING (place, category, election_date)
       LEFT JOIN lw ON lw.splace=vt.place AND lw.category=vt.category AND lw.election_date=vt.election_date)
"""
_VERIFY = sql_facts("," + UNITS_SQL + "," + TOTALS_SQL + "," + _LOCAL)


def _parts(rows: DataFrame):
    # Pages are a stored table; layers and totals serve several comparisons.
    sets = stage(verify.page_sets(official_pages(rows)))
    summaries = stage(verify.set_summaries(sets))
    chosen, local = verify.local_layers(rows, summaries)
    totals = verify.official_totals(sets)
    return sets, summaries, chosen, local, totals


def _fields(spark, sf_dir):
    sets, summaries, chosen, _, totals = _parts(stored_facts(spark, sf_dir))
    valid = verify.official_valid_votes(sets, totals)
    return verify.compare_fields(summaries, valid, chosen, tolerance=TOLERANCE)


@query(_VERIFY + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, campo, ufficiale, ricostruito,
       scarto, CAST(coincide AS VARCHAR) AS coincide FROM vf""")
def verify_fields(spark, sf_dir):
    return plain(_fields(spark, sf_dir).drop("scarto_relativo"))


@query(_VERIFY + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, subject_key, partito_ufficiale,
       partito_ricostruito, voti_ufficiali, voti_ricostruiti, scarto, stato FROM vs""")
def verify_subjects(spark, sf_dir):
    _, _, chosen, local, totals = _parts(stored_facts(spark, sf_dir))
    return plain(
        verify.compare_subjects(totals, chosen, local, tolerance=TOLERANCE).drop("scarto_relativo")
    )


def _status(rows: DataFrame):
    sets, summaries, chosen, local, totals = _parts(rows)
    valid = verify.official_valid_votes(sets, totals)
    fields = verify.compare_fields(summaries, valid, chosen, tolerance=TOLERANCE)
    subjects = verify.compare_subjects(totals, chosen, local, tolerance=TOLERANCE)
    return sets, verify.verification_status(summaries, chosen, fields, subjects)


_STATUS = (
    "place", "category", "election_date", "partiti_confrontati", "partiti_coincidenti",
    "partiti_non_coincidenti", "pezzi_open_data", "stato",
)


@query(_VERIFY + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, partiti_confrontati,
       partiti_coincidenti, partiti_non_coincidenti, pezzi_open_data, stato FROM vo""")
def verify_status(spark, sf_dir):
    return plain(_status(stored_facts(spark, sf_dir))[1].select(*_STATUS))


# Page sets ------------------------------------------------------------------


@query(sql_facts() + """
, p AS (SELECT DISTINCT concat_ws('|', mkey, coalesce(province,'-'), category,
                 CASE WHEN category='europee' THEN year(election_date)//2 ELSE year(election_date) END,
                 CASE WHEN category='senato' THEN region END, CASE WHEN category='comunali' THEN constituency END) AS set_id,
               CASE WHEN category='referendum' AND region='ASIA' THEN 'altro' ELSE category END AS category,
               election_date, mkey, province, region, constituency FROM f WHERE mkey IS NOT NULL),
g AS (SELECT set_id, count(DISTINCT category) AS c, count(DISTINCT election_date) AS d,
             count(DISTINCT coalesce(province,'')) AS p, count(DISTINCT coalesce(region,'')) AS r,
             count(DISTINCT constituency) AS k FROM p GROUP BY ALL)
SELECT set_id, CASE WHEN c>1 THEN 'different_chamber' WHEN d>1 THEN 'different_election_date'
       WHEN p>1 THEN 'different_province' WHEN r>1 THEN 'different_region'
       WHEN k>1 THEN 'different_constituency' END AS reason FROM g WHERE c>1 OR d>1 OR p>1 OR r>1 OR k>1""")
def page_set_rejects(spark, sf_dir):
    """Sets over all pages; each category's sets are cut so that another rule strikes."""
    rows = facts(spark, sf_dir).where(F.col("municipality").isNotNull())
    kind, year = F.col("category"), F.year("election_date")
    canonical = canonical_municipality(F.col("municipality"))
    pages = rows.select(
        F.concat_ws(
            "|", slug(canonical), F.coalesce("province", F.lit("-")), "category",
            F.when(kind == "europee", F.floor(year / 2)).otherwise(year).cast("string"),
            F.when(kind == "senato", F.col("region")), F.when(kind == "comunali", F.col("constituency")),
        ).alias("set_id"),
        F.when((kind == "referendum") & (F.col("region") == "ASIA"), "altro").otherwise(kind).alias("category"),
         "election_date", "municipality", "province", "region", "constituency",
    ).distinct()
    return verify.page_set_rejects(pages)


# Closures ------------------------------------------------------------------


def _tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Municipality pages under region pages, with defects by election year."""
    year = F.year("election_date")
    named = rows.where(
        F.col("region").isNotNull() & F.col("municipality").isNotNull() & (F.col("result_type") == "list")
    ).withColumn(
        "parent_url", F.concat_ws("/", "category", F.col("election_date").cast("string"), "region")
    ).withColumn(
        "url", F.concat_ws("/", "parent_url", F.coalesce("province", F.lit("-")), "municipality_key")
    )
    by_subject = named.groupBy("category", "election_date", "parent_url", "url", "subject").agg(
        F.sum("votes").alias("votes")
    )
    measures = named.groupBy("category", "election_date", "parent_url", "url").agg(
        F.max("electors").alias("electors"), F.max("voters").alias("voters")
    )

    def records(votes: DataFrame, *keys: str) -> DataFrame:
        # One record per subject of a page.
        null = F.lit(None).cast("bigint")
        return votes.groupBy(*keys).agg(
            F.collect_list(
                F.struct(
                    F.lit("list").alias("record_type"), F.col("subject").alias("name"),
                    null.alias("round"), "votes",
                )
            ).alias("records")
        )

    children = measures.join(records(by_subject, "url"), "url").withColumn("label", F.lit(None).cast("string"))
    missing = (F.col("category") == "comunali") & (year % 2 == 1)
    # Every third year a subject of the parent gains a vote.
    parent_votes = by_subject.groupBy("category", "election_date", "parent_url", "subject").agg(
        F.sum("votes").alias("votes")
    ).withColumn(
        "votes",
        F.col("votes") + F.when((year % 3 == 0) & (F.col("votes") % 3 == 0), 1).otherwise(0),
    )
    parents = (
        measures.groupBy("category", "election_date", "parent_url")
        .agg(F.sum("electors").alias("electors"), F.sum("voters").alias("voters"))
        .where(~missing)
        .withColumn("electors", F.when(year % 3 != 1, F.col("electors")))
        .join(records(parent_votes, "parent_url"), "parent_url")
        .withColumn("url", F.col("parent_url"))
        .withColumn("label", F.substring_index("parent_url", "/", -1))
    )
    columns = ["url", "label", "electors", "voters", "records"]
    return (
        stage(children.select(*columns).unionByName(parents.select(*columns))),
        stage(measures.select("parent_url", F.col("url").alias("child_url"))),
    )


_TREE = """
, m AS (SELECT category, election_date, concat(category,'/',CAST(election_date AS VARCHAR),'/',region) AS parent_url,
       concat(category,'/',CAST(election_date AS VARCHAR),'/',region,'/',coalesce(province,'-'),'/',mkey) AS url, region,
       subject, subject_key, votes, electors, voters
       FROM f WHERE region IS NOT NULL AND mkey IS NOT NULL AND result_type='list'),
ch AS (SELECT category, election_date, parent_url, region, url, max(electors) AS e, max(voters) AS v, sum(votes)::BIGINT AS n
       FROM m GROUP BY ALL),
pv AS (SELECT category, election_date, parent_url, subject_key, sum(votes)::BIGINT AS child_votes,
       sum(votes)::BIGINT + CASE WHEN year(election_date)%3=0 AND sum(votes)%3=0 THEN 1 ELSE 0 END AS parent_votes
       FROM m GROUP BY category, election_date, parent_url, subject_key),
pc AS (SELECT category, election_date, parent_url, region, count(*) AS child_pages,
       CASE WHEN count(e)=count(*) THEN sum(e)::BIGINT END AS child_electors,
       sum(v)::BIGINT AS child_voters, sum(n)::BIGINT AS child_valid_votes, sum(e)::BIGINT AS pe
       FROM ch GROUP BY ALL),
pk AS (SELECT parent_url, count(*) AS compared, count(*) FILTER (child_votes<>parent_votes) AS apart,
       sum(parent_votes)::BIGINT AS pvalid FROM pv GROUP BY ALL),
cl AS (SELECT pc.*, pk.*, category='comunali' AND year(election_date)%2=1 AS missing FROM pc JOIN pk USING (parent_url)),
cs AS (SELECT parent_url, CASE WHEN NOT missing THEN region END AS parent_label, child_pages,
       CASE WHEN NOT missing AND year(election_date)%3<>1 THEN pe END AS parent_electors, child_electors,
       CASE WHEN NOT missing THEN child_voters END AS parent_voters, child_voters,
       CASE WHEN NOT missing THEN pvalid END AS parent_valid_votes, child_valid_votes,
       CASE WHEN missing THEN 0 ELSE compared END AS subjects_compared,
       CASE WHEN missing THEN 0 ELSE apart END AS subjects_mismatched, missing FROM cl)
"""


@query(sql_facts() + _TREE + """
SELECT * EXCLUDE (missing), CASE WHEN missing THEN 'parent_missing'
       WHEN subjects_mismatched>0 OR coalesce(parent_electors<>child_electors,false) OR parent_voters<>child_voters
            OR parent_valid_votes<>child_valid_votes THEN 'mismatch'
       WHEN parent_electors IS NULL OR child_electors IS NULL THEN 'incomplete' ELSE 'closed' END AS status
FROM cs""")
def parent_closure(spark, sf_dir):
    return plain(closure.parent_closures(*_tree(stored_facts(spark, sf_dir)))[0])


@query(sql_facts() + _TREE + """
SELECT parent_url, concat('list:',subject_key) AS subject, parent_votes, child_votes FROM pv
WHERE parent_votes<>child_votes AND NOT (category='comunali' AND year(election_date)%2=1)""")
def closure_mismatches(spark, sf_dir):
    return plain(closure.parent_closures(*_tree(stored_facts(spark, sf_dir)))[1])


# Legal pieces and completeness ---------------------------------------------


def _registry(rows: DataFrame) -> DataFrame:
    """A registry of colleges written from the view, without college 3 of Rome."""
    key = slug(canonical_municipality(F.col("municipality")))
    # Labels are few: rows meet before labels are made canonical.
    return (
        rows.where(F.col("municipality").isNotNull() & F.col("category").isin("camera", "senato"))
        .select("category", "constituency", "region", "college", "municipality").distinct()
        .select(
            F.concat("category", F.lit("-mattarellum-1993-corrected")).alias("map_version"),
            F.when(F.col("category") == "camera", F.col("constituency")).otherwise(F.col("region")).alias("geography"),
            F.regexp_extract("college", r"(\d+)$", 1).alias("college"),
            key.alias("municipality"),
        )
        .where(~((F.col("municipality") == "roma") & (F.col("college") == "3")))
        .where(~((F.col("map_version").startswith("senato")) & (F.col("municipality") == "veronella")))
        .distinct()
    )


def _college_pages(rows: DataFrame) -> DataFrame:
    placed = layers.with_keys(rows).where(F.col("municipality").isNotNull())
    labels = placed.groupBy("place", "category", "election_date", "college", "municipality").agg(
        F.max("constituency").alias("constituency"), F.max("region").alias("region")
    )
    return labels.groupBy("place", "category", "election_date", "college").agg(
        F.max(canonical_municipality(F.col("municipality"))).alias("municipality"),
        F.max("constituency").alias("constituency"),
        F.max("region").alias("region"),
    ).withColumn("college_code", F.regexp_extract("college", r"(\d+)$", 1))


_LEGAL = """
, pg AS (SELECT place, category, election_date, college, max(mkey) AS mkey, max(constituency) AS constituency,
                max(region) AS region, CAST(right(college,1) AS INTEGER) AS code
         FROM f WHERE mkey IS NOT NULL GROUP BY ALL),
sg AS (SELECT place, category, election_date, count(*) AS pagine, max(mkey) AS mkey,
              CASE WHEN category='camera' THEN max(constituency) ELSE max(region) END AS geography,
              list_sort(list(DISTINCT code)) AS web FROM pg GROUP BY place, category, election_date),
rg AS (SELECT DISTINCT category, CASE WHEN category='camera' THEN constituency ELSE region END AS geography,
              CAST(right(college,1) AS INTEGER) AS code, mkey FROM f
       WHERE mkey IS NOT NULL AND category IN ('camera','senato') AND NOT (mkey='roma' AND right(college,1)='3')
         AND NOT (category='senato' AND mkey='veronella')),
lg AS (SELECT sg.*, CASE WHEN category IN ('camera','senato') THEN coalesce((SELECT list_sort(list(DISTINCT rg.code)) FROM rg WHERE rg.category=sg.category
              AND rg.mkey=sg.mkey AND (sg.geography IS NULL OR rg.geography=sg.geography)), []) END AS legal FROM sg),
lp AS (SELECT *, CASE WHEN legal IS NULL THEN 'not_available' WHEN len(legal)=0 THEN 'not_found'
              WHEN len(web)=pagine THEN CASE WHEN web=legal THEN 'pass' ELSE 'mismatch' END
              WHEN pagine=len(legal) THEN 'pass' ELSE 'mismatch' END AS stato FROM lg)
"""


@query(sql_facts() + _LEGAL + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, pagine, stato,
       array_to_string(web, ',') AS collegi_pagine, array_to_string(legal, ',') AS collegi_legali,
       CASE WHEN category IN ('camera','senato') THEN concat(category,'-mattarellum-1993-corrected') END AS mappa_collegi_versione
FROM lp""")
def legal_piece_count(spark, sf_dir):
    rows = stage(
        facts(spark, sf_dir, keyed=True)
        .select("canonical_key", "place", "category", "election_date", "college", "municipality", "constituency", "region").distinct()
    )
    return plain(verify.legal_piece_count(_college_pages(rows), _registry(rows)))


@query(_VERIFY + _LEGAL + """
SELECT vo.place, vo.category, CAST(vo.election_date AS VARCHAR) AS election_date, vo.stato,
       CASE WHEN reasons = '' THEN 'complete' ELSE 'incomplete' END AS completezza, reasons AS completezza_motivi
FROM (SELECT vo.*, concat_ws(',', CASE WHEN vo.stato<>'exact_match' THEN 'piece_match' END,
        CASE WHEN year(vo.election_date)=1997 THEN 'college_closure_not_available'
             WHEN year(vo.election_date)%3=0 THEN 'college_closure_fail' END,
        CASE WHEN lp.stato='mismatch' THEN 'legal_piece_count' END) AS reasons
      FROM vo LEFT JOIN lp USING (place, category, election_date)) vo""")
def completeness(spark, sf_dir):
    rows = stored_facts(spark, sf_dir)
    sets, status = _status(rows)
    parent = F.concat_ws("/", "category", F.col("election_date").cast("string"))
    edges = sets.select(F.col("url").alias("child_url"), parent.alias("parent_url"))
    closures = (
        rows.select("category", "election_date").distinct()
        .where(F.year("election_date") != 1997)
        .select(
            parent.alias("parent_url"),
            F.when(F.year("election_date") % 3 == 0, "mismatch").otherwise("closed").alias("status"),
        )
    )
    judged = verify.completeness(
        status,
        verify.closure_outcome(sets, closures, edges),
        verify.legal_piece_count(_college_pages(rows), _registry(rows)),
    )
    return plain(judged.select("place", "category", "election_date", "stato", "completezza", "completezza_motivi"))
