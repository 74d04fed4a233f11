"""An election-shaped view over a star schema of orders.

Priorities stand for election categories, order years for election dates,
suppliers for the fragments of municipalities and brands for lists and
candidates.  ``ELECTION_SQL`` states the same view for another SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urna.functions.numbers import percentage
from urna.functions.text import canonical_municipality, place_key, slug
from urna.session import stage

_LABELS = (
    "ROMA I", "Roma - Appio", "Milano 10", "Parte di Comune TARANTO",
    "Firenze Nord", "VERONELLA", "ROMA", "Reggio di Calabria",
)

ELECTION_SQL = """
SELECT CASE substr(o.o_orderpriority,1,1) WHEN '1' THEN 'camera' WHEN '2' THEN 'senato'
            WHEN '3' THEN 'europee' WHEN '4' THEN 'referendum' ELSE 'comunali' END AS category,
       make_date(CAST(year(o.o_orderdate) AS INTEGER),1,1) AS election_date,
       CAST(CASE WHEN l.l_linenumber % 3 = 0 THEN NULL WHEN l.l_linestatus='O' THEN 1 ELSE 2 END AS BIGINT) AS round,
       CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE r.r_name END AS region,
       CASE WHEN l.l_suppkey % 7 = 0 OR l.l_suppkey % 13 = 0 THEN NULL ELSE n.n_name END AS province,
       concat(r.r_name,' ',CAST(l.l_suppkey % 3 AS VARCHAR)) AS constituency,
       CASE WHEN l.l_suppkey % 11 = 0 OR l.l_suppkey % 26 = 0 THEN NULL ELSE CASE l.l_suppkey % 8
            WHEN 0 THEN 'ROMA I' WHEN 1 THEN 'Roma - Appio' WHEN 2 THEN 'Milano 10'
            WHEN 3 THEN 'Parte di Comune TARANTO' WHEN 4 THEN 'Firenze Nord'
            WHEN 5 THEN 'VERONELLA' WHEN 6 THEN 'ROMA' ELSE 'Reggio di Calabria' END END AS municipality,
       CASE WHEN l.l_suppkey % 52 = 0 OR l.l_suppkey % 44 = 0 THEN 'FRANCIA' END AS country,
       concat('COLLEGIO ',CAST(l.l_suppkey % 4 AS VARCHAR)) AS college,
       CASE WHEN substr(o.o_orderpriority,1,1) = '4' THEN CAST(l.l_partkey % 3 + 1 AS VARCHAR) END AS question_number,
       CASE l.l_returnflag WHEN 'R' THEN 'candidate' ELSE 'list' END AS result_type,
       p.p_brand AS subject,
       CAST(l.l_quantity AS BIGINT) * 20 AS votes,
       CAST(l.l_linenumber - 1 AS BIGINT) AS seats,
       CASE WHEN year(o.o_orderdate)=1996 AND l.l_suppkey % 4 = 1 THEN NULL
            ELSE 4000 + (l.l_suppkey*137 + year(o.o_orderdate)*211) % 3000 END AS electors,
       2000 + (l.l_suppkey*101 + year(o.o_orderdate)*307) % 2400 AS voters,
       1900 + (l.l_suppkey*101 + year(o.o_orderdate)*307) % 2400 AS valid_votes,
       l.l_suppkey % 100 AS blank_ballots,
       concat(o.o_orderpriority,'-',l.l_returnflag) AS source_file,
       ((l.l_orderkey*10 + l.l_linenumber)*100000 + l.l_partkey % 100000)*10000 + l.l_suppkey % 10000 AS source_row,
       CAST(l.l_linenumber AS BIGINT) AS section
FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey
JOIN supplier s ON s.s_suppkey=l.l_suppkey
JOIN nation n ON n.n_nationkey=s.s_nationkey
JOIN region r ON r.r_regionkey=n.n_regionkey
JOIN part p ON p.p_partkey=l.l_partkey
"""

ARCHIVE_SQL = """
SELECT DISTINCT category, election_date,
       concat(category,'-',CAST(year(election_date) AS VARCHAR),'.zip') AS filename,
       concat('https://dait.interno.gov.it/documenti/opendata/',category,'/',category,'-',CAST(year(election_date) AS VARCHAR),'.zip') AS download_url,
       sha256(concat(category,'-',CAST(year(election_date) AS VARCHAR),'.zip')) AS sha256
FROM (SELECT CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'camera' WHEN '2' THEN 'senato'
                  WHEN '3' THEN 'europee' WHEN '4' THEN 'referendum' ELSE 'comunali' END AS category,
             make_date(CAST(year(o_orderdate) AS INTEGER),1,1) AS election_date FROM orders)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category() -> Column:
    digit = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(digit == "1", "camera")
        .when(digit == "2", "senato")
        .when(digit == "3", "europee")
        .when(digit == "4", "referendum")
        .otherwise("comunali")
    )


def _election_date() -> Column:
    return F.trunc("o_orderdate", "year")


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with the keys of its places and subjects, made once a supplier and part, not once a row."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
        "l_linestatus",
    )
    supplier = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "n_name", "r_name")
    )
    unit = F.col("s_suppkey")
    label = F.element_at(
        F.array(*[F.lit(x) for x in _LABELS]), (unit % 8 + 1).cast("int")
    )
    supplier = supplier.withColumns(
        {
            "region": F.when(unit % 13 != 0, F.col("r_name")),
            "province": F.when((unit % 7 != 0) & (unit % 13 != 0), F.col("n_name")),
            "constituency": F.concat_ws(" ", "r_name", (unit % 3).cast("string")),
            "municipality": F.when((unit % 11 != 0) & (unit % 26 != 0), label),
        }
    ).withColumn("canonical", canonical_municipality(F.col("municipality"))).withColumn(
        "municipality_key", slug(F.col("canonical"))
    ).withColumn(
        "place", place_key(F.col("municipality_key"), F.col("province"), F.col("region"), F.col("constituency"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", slug(F.col("p_brand")).alias("subject_key"))
    # What carries text joins last: rows are narrow while they are shuffled.
    joined = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(
            table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    unit, year = F.col("l_suppkey"), F.year("o_orderdate").cast("bigint")
    turnout = (unit * 101 + year * 307) % 2400
    return joined.select(
        _category().alias("category"),
        _election_date().alias("election_date"),
        F.when(F.col("l_linenumber") % 3 != 0, F.when(F.col("l_linestatus") == "O", 1).otherwise(2))
        .cast("bigint")
        .alias("round"),
        "region", "province", "constituency", "municipality",
        F.when((unit % 52 == 0) | (unit % 44 == 0), F.lit("FRANCIA")).alias("country"),
        F.concat(F.lit("COLLEGIO "), (unit % 4).cast("string")).alias("college"),
        F.when(_category() == "referendum", (F.col("l_partkey") % 3 + 1).cast("string")).alias(
            "question_number"
        ),
        F.when(F.col("l_returnflag") == "R", "candidate").otherwise("list").alias("result_type"),
        F.col("p_brand").alias("subject"),
        (F.col("l_quantity").cast("bigint") * 20).alias("votes"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("seats"),
        F.when(~((year == 1996) & (unit % 4 == 1)), 4000 + (unit * 137 + year * 211) % 3000).alias(
            "electors"
        ),
        (2000 + turnout).alias("voters"),
        (1900 + turnout).alias("valid_votes"),
        (unit % 100).alias("blank_ballots"),
        F.concat_ws("-", "o_orderpriority", "l_returnflag").alias("source_file"),
        # Unique per row, so that "first row" is well defined.
        (
            (
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000
                + F.col("l_partkey") % 100000
            )
            * 10000
            + unit % 10000
        ).alias("source_row"),
        F.col("l_linenumber").cast("bigint").alias("section"),
        "canonical", "municipality_key", "place", "subject_key",
    )


def election_rows(spark: SparkSession, sf_dir: str, *, keyed: bool = False) -> DataFrame:
    """The view of ``ELECTION_SQL``, one row per published subject; ``keyed``: with canonical label and its key."""
    rows = _view(spark, sf_dir).drop("place", "subject_key")
    return rows if keyed else rows.drop("canonical", "municipality_key")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive catalogue: one row per category and election date."""
    name = F.concat_ws("-", "category", F.year("election_date").cast("string"))
    filename = F.concat(name, F.lit(".zip"))
    return (
        table(spark, sf_dir, "orders")
        .select(_category().alias("category"), _election_date().alias("election_date"))
        .distinct()
        .select(
            "category",
            "election_date",
            name.alias("archive"),
            filename.alias("filename"),
            F.concat(
                F.lit("https://dait.interno.gov.it/documenti/opendata/"), "category", F.lit("/"), filename
            ).alias("download_url"),
            F.sha2(filename, 256).alias("sha256"),
        )
    )


def facts(spark: SparkSession, sf_dir: str, *, keyed: bool = False) -> DataFrame:
    """The view in the full result-fact schema, labels as stored; ``keyed``: with the keys that an import stores."""
    rows = _view(spark, sf_dir)
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    is_list = F.col("result_type") == "list"
    keys = [F.col("municipality_key").alias("canonical_key"), "place"] if keyed else []
    return rows.select(
        F.concat_ws("-", "category", F.year("election_date").cast("string")).alias("archive"),
        "category", "election_date", "round", "region", "constituency", "province", "municipality",
        "municipality_key", "country", "college", "question_number", text.alias("question"),
        "result_type", "subject", "subject_key",
        F.when(is_list, F.col("subject")).alias("party"),
        F.when(~is_list, F.col("subject")).alias("candidate"),
        text.alias("option"), "votes",
        percentage(F.col("votes"), F.col("valid_votes")).alias("percentage"),
        "seats", "electors", whole.alias("male_electors"), "voters", whole.alias("male_voters"),
        percentage(F.col("voters"), F.col("electors")).alias("turnout_percentage"),
        "valid_votes", whole.alias("valid_list_votes"), whole.alias("valid_candidate_votes"),
        "blank_ballots", whole.alias("invalid_ballots"), whole.alias("contested_ballots"),
        "source_file", "source_row", *keys,
    )


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table as an import leaves it: written once, keys included.

    For queries that pass over the facts several times.
    """
    return stage(facts(spark, sf_dir, keyed=True))


# The same notions for the other engine -------------------------------------


def sql_slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def sql_canonical(x: str) -> str:
    """Place canonicalisation of ASCII labels in the other engine's dialect."""
    from urna import fixed_values as fv

    cities = "|".join(c.lower() for c in fv.SPLIT_CITIES)
    clean = f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"
    part = f"nullif(upper(regexp_extract(lower({clean}), '^parte\\s+(?:di|del)\\s+comune(?:\\s+di)?\\s+(.+)$', 1)), '')"
    city = (
        f"nullif(upper(regexp_extract(lower({clean}), '^({cities})"
        f"( - | centro| nord| sud| est| ovest| zona |: municipio |: quartiere |: zona |\\s+\\d+$|\\s+[ivxlcdm]+$)', 1)), '')"
    )
    return (
        f"CASE WHEN lower({clean}) = 'reggio di calabria' OR {part} = 'REGGIO DI CALABRIA' "
        f"THEN 'REGGIO CALABRIA' ELSE coalesce({part}, {city}, {clean}) END"
    )


def sql_facts(extra: str = "") -> str:
    """``er`` and ``f`` (keys added) as leading CTEs."""
    canonical = sql_canonical("municipality")
    return (
        f"WITH er AS ({ELECTION_SQL}), ar AS ({ARCHIVE_SQL}), "
        f"c AS (SELECT *, {canonical} AS canonical FROM er), "
        f"f AS (SELECT *, {sql_slug('canonical')} AS mkey, {sql_slug('subject')} AS subject_key, "
        f"CASE WHEN canonical IS NULL THEN NULL WHEN province IS NOT NULL THEN concat('p:',{sql_slug('province')},'|',{sql_slug('canonical')}) "
        f"WHEN region IS NOT NULL THEN concat('r:',{sql_slug('region')},'|',{sql_slug('canonical')}) "
        f"ELSE concat('c:',{sql_slug('constituency')},'|',{sql_slug('canonical')}) END AS place FROM c)"
        f"{extra} "
    )
