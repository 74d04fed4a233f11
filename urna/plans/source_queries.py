"""Source queries: the view is written out as archives and pages, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.functions.numbers import as_int
from urna.functions.text import canonical_municipality
from urna.functions.urls import query_code, url_policy
from urna.operators import traversal, verify
from urna.plans.election_view import archives, election_rows, facts, sql_facts, table
from urna.plans.encodings import archive_files, dotted, encoded_files
from urna.plans.shape import plain
from urna.session import stage
from urna.sources import archives as zips, catalogue, pages

QUERIES, ORACLE = {}, {}
_SITE = "https://elezionistorico.interno.gov.it/index.php"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


@query(sql_facts() + """
SELECT CASE WHEN source_row % 3 = 0 THEN 'dati/voti.xlsx#Dati' ELSE 'dati/voti_comune.txt' END AS file_name,
       category, CAST(election_date AS VARCHAR) AS election_date, region, constituency, province,
       canonical AS municipality, mkey AS municipality_key, college, round, electors, voters, subject, votes, source_row
FROM f WHERE source_row % 3 <> 2""")
def archive_scan(spark, sf_dir):
    rows, _ = zips.read_archives(archive_files(election_rows(spark, sf_dir)))

    def text(name: str):
        return F.nullif(F.try_element_at("payload", F.lit(name)), F.lit(""))

    def number(name: str):
        return as_int(
            F.try_element_at("payload", F.lit(name)), F.try_element_at("numbers", F.lit(name))
        )

    return rows.select(
        "file_name",
        text("categoria").alias("category"),
        text("dataelezione").alias("election_date"),
        "region", "constituency", "province", "municipality", "municipality_key",
        text("collegio").alias("college"),
        number("turno").alias("round"),
        number("elettori").alias("electors"),
        number("votanti").alias("voters"),
        text("lista").alias("subject"),
        number("voti_lista").alias("votes"),
        number("riga").alias("source_row"),
    )


@query("SELECT 'unsafe path: ../fuori.txt' AS error, 0 AS balance")
def archive_rejects(spark, sf_dir):
    """Each batch writes one unsafe archive: all of these, and only these, are rejected."""
    files = stage(archive_files(election_rows(spark, sf_dir)))
    _, rejects = zips.read_archives(files, municipality_level_only=False)
    unsafe = files.where(F.col("path").startswith("esterno")).select(
        F.lit("unsafe path: ../fuori.txt").alias("error"), F.lit(1).alias("n")
    )
    both = unsafe.unionByName(rejects.select("error", F.lit(-1).alias("n")))
    return both.groupBy("error").agg(F.sum("n").alias("balance"))


@query("""
SELECT CASE k WHEN 0 THEN 'utf8/voti.csv' WHEN 1 THEN 'ansi/voti.csv' WHEN 2 THEN 'latino/voti.csv' WHEN 3 THEN 'referendum/dati.csv' ELSE 'comunali/dati.csv' END AS file_name,
       concat(CASE k WHEN 0 THEN 'Forlì ' WHEN 1 THEN 'Cantù € ' WHEN 2 THEN concat('Gaetà', chr(129), ' ') ELSE 'Cantù ' END, c_custkey) AS comune,
       concat(CASE k WHEN 3 THEN 'Sì o no ' ELSE 'Più ' END, c_custkey) AS soggetto, c_custkey * 3 AS voti
FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def archive_encodings(spark, sf_dir):
    """Members in every encoding of the ladder and both headerless layouts."""
    files = encoded_files(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))
    rows, _ = zips.read_archives(files, municipality_level_only=False)
    first = lambda *names: F.coalesce(*[F.try_element_at("payload", F.lit(n)) for n in names])
    return rows.select(
        "file_name", first("comune").alias("comune"), first("lista", "quesito", "descrlista").alias("soggetto"),
        first("voti_lista", "numvotisi", "votilista").cast("bigint").alias("voti"),
    )


# Pages -------------------------------------------------------------------------

def _code():
    return (
        F.when(F.col("category") == "camera", "C")
        .when(F.col("category") == "senato", "S")
        .when(F.col("category") == "europee", "E")
        .when(F.col("category") == "referendum", "F")
        .otherwise("G")
    )


def _printed(label: str, column: str):
    """A level of the heading, nothing where the view has none."""
    return F.coalesce(F.concat(F.lit(f" <i></i> {label} "), F.col(column)), F.lit(""))


_PAGE = ["category", "election_date", "region", "province", "city"]


def _query_value(column: str):
    return F.replace(F.coalesce(F.col(column), F.lit("")), F.lit(" "), F.lit("+"))


def page_results(rows: DataFrame) -> DataFrame:
    """What pages print of the view, written once: votes and figures by place, round and subject.

    Pages add these up again, so sites of several kinds of pages do not pass over the
    view for each, and places are made canonical by their different labels only.
    """
    keys = ["category", "election_date", "region", "province", "municipality", "round", "result_type", "subject"]
    summed = rows.groupBy(*keys).agg(F.sum("votes").alias("votes"), F.max("electors").alias("electors"), F.max("voters").alias("voters"))
    return stage(summed.withColumn("city", canonical_municipality(F.col("municipality"))))


def page_bodies(rows: DataFrame, *keys: str) -> DataFrame:
    """One result page per value of ``keys``: (keys..., html); lists, candidates and options of every round."""
    kind = F.when(F.col("category") == "referendum", "option").otherwise(F.col("result_type")).alias("kind")
    page = F.struct(*keys).alias("page")
    votes = rows.groupBy(page, kind, "subject").agg(
        F.sum(F.when(F.col("round").isNull() | (F.col("round") == 1), F.col("votes"))).alias("first"),
        F.sum(F.when(F.col("round") == 2, F.col("votes"))).alias("second"),
    )
    runoff = F.col("page.category") == "comunali"
    number = F.regexp_extract("subject", r"(\d+)$", 1)
    own = F.when(F.col("kind") == "candidate", F.concat(F.lit("candidato"), number)).otherwise("lista")

    def cell(header: str, value):
        return F.coalesce(F.concat(F.lit(f'<td headers="{header} '), own, F.lit('">'), dotted(value), F.lit("</td>")), F.lit(""))

    head = (
        F.when(F.col("kind") == "candidate", F.concat(
            F.lit('<tr class="leader"><td class="nome" id="'), own, F.lit('">'), F.col("subject"), F.lit('</td><td class="text-left">Eletto</td>')))
        .when(F.col("kind") == "option", F.concat(F.lit("<tr><th>"), F.col("subject"), F.lit("</th>")))
        .otherwise(F.concat(
            F.lit('<tr><td><img src="/simboli/'), F.col("subject"), F.lit('.png"></td><th class="candidato" id="lista">'),
            F.col("subject"), F.lit("</th>")))
    )
    line = F.concat(
        head, cell("hvoti", F.col("first")),
        F.when(runoff, cell("hvoti2", F.col("second"))).otherwise(""), F.lit("</tr>\n"),
    )
    # One line per subject of a page.
    bodies = votes.groupBy("page").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body"))
    measures = rows.groupBy(page).agg(F.max("electors").alias("electors"), F.max("voters").alias("voters"))
    levels = [(label, key) for label, key in (("Regione", "region"), ("Provincia", "province"), ("Comune", "city")) if key in keys]
    html = F.concat(
        F.lit('<html><body><div id="headEnti"><h3>'), F.initcap("category"), F.lit(" "),
        F.date_format("election_date", "dd/MM/yyyy"), F.lit(" <i></i> Area ITALIA"),
        *[_printed(label, key) for label, key in levels],
        F.lit('</h3></div><table class="dati_riepilogo"><tr><th>Affluenza</th></tr>'),
        F.coalesce(F.concat(F.lit("<tr><th>Elettori</th><td>"), dotted(F.col("electors")), F.lit("</td></tr>")), F.lit("")),
        F.lit("<tr><th>Votanti</th><td>"), dotted(F.col("voters")),
        F.lit('</td><td class="percentuale">75,15 %</td></tr></table>'),
        F.lit('<table summary="Risultati elezione"><thead><tr><th id="hvoti">Voti</th>'),
        F.when(runoff, F.lit('<th id="hvoti2">Voti II</th>')).otherwise(""),
        F.lit("</tr></thead><tbody>\n"), F.col("body"), F.lit("</tbody></table></body></html>"),
    )
    # A struct as key: pages without region, province or city are pages as well.
    both = bodies.join(measures, "page").select("page", "body", "electors", "voters", "page.*")
    return both.select(*keys, html.alias("html"))


def rendered_pages(rows: DataFrame) -> DataFrame:
    """(url, html) of one result page per region, province and municipality, all rows of the view."""
    named = page_results(rows)
    url = F.concat(
        F.lit(f"{_SITE}?tpel="), _code(), F.lit("&dtel="), F.date_format("election_date", "yyyyMMdd"),
        F.lit("&lev1="), _query_value("region"), F.lit("&lev2="), _query_value("province"), F.lit("&lev3="), _query_value("city"),
    )
    return page_bodies(named, *_PAGE).select(url.alias("url"), "html")


@query(sql_facts() + """
, n AS (SELECT *, CASE WHEN category='referendum' THEN 'option' ELSE result_type END AS kind,
        concat_ws('|', category, CAST(election_date AS VARCHAR), coalesce(region,'~'), coalesce(province,'~'), coalesce(canonical,'~')) AS page FROM f),
m AS (SELECT page, max(electors) AS electors, max(voters) AS voters FROM n GROUP BY page),
v AS (SELECT page, category, election_date, region, province, canonical, kind, subject,
      sum(votes) FILTER (round IS NULL OR round=1)::BIGINT AS v1, sum(votes) FILTER (round=2)::BIGINT AS v2 FROM n GROUP BY ALL)
SELECT CASE WHEN category<>'referendum' THEN category END AS category, concat(upper(category[1]), category[2:]) AS election_name,
       CAST(election_date AS VARCHAR) AS election_date, region, province, canonical AS municipality,
       electors, voters, kind AS record_type, CASE kind WHEN 'candidate' THEN concat('candidato', regexp_extract(subject,'([0-9]+)$',1)) WHEN 'list' THEN 'lista' END AS record_id,
       CASE kind WHEN 'candidate' THEN 'Eletto' END AS status, subject AS name, r.rd AS round, r.v AS votes,
       CASE kind WHEN 'list' THEN concat('https://elezionistorico.interno.gov.it/simboli/', split_part(subject,'#',1)) END AS symbol
FROM (SELECT v.*, m.electors, m.voters, unnest(CASE WHEN category='comunali' THEN
        CASE WHEN v2 IS NOT NULL THEN [{'rd':1,'v':v1},{'rd':2,'v':v2}] ELSE [{'rd':1,'v':v1}] END
        ELSE [{'rd':NULL,'v':v1}] END) AS r
      FROM v JOIN m USING (page))""")
def page_extract(spark, sf_dir):
    parsed = pages.read_pages(rendered_pages(facts(spark, sf_dir)))
    places = ["category", "election_date", "region", "province", "municipality", "electors", "voters"]
    read = pages.municipality_pages(parsed)
    return plain(
        read.select(*places, "election_name", F.explode("records").alias("r"))
        .select(
            *places, "election_name", "r.record_type", "r.record_id", "r.status", "r.name", "r.round", "r.votes",
            F.substring_index("r.symbol_url", "#", 1).alias("symbol"),
        )
    )


@query("""
SELECT reason, count(*) AS n, count(DISTINCT url) AS urls FROM (
  SELECT url, CASE WHEN html LIKE '%id="headEnti"%' THEN 'other' ELSE 'election heading not found' END AS reason FROM pages)
GROUP BY ALL""")
def page_rejects(spark, sf_dir):
    """Ordinary web pages hold no result table: all go to the reject side."""
    parsed = pages.read_pages(table(spark, sf_dir, "pages").select("url", "html"))
    return (
        parsed.where(F.col("error").isNotNull())
        .groupBy(F.col("error").alias("reason"), "url")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("reason")
        .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("urls"))
    )


def selector_pages(rows: DataFrame) -> DataFrame:
    """(url, html) of one selector page per election and region, options per municipality."""
    options = rows.groupBy("category", "election_date", "region", "municipality_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    code = F.crc32(F.col("municipality_key").cast("binary")).cast("string")
    # A row without municipality opens nothing.
    option = F.concat(
        F.lit('<option value="'), code, F.lit("-lev3"), code, F.lit('">'), F.col("municipality_key"), F.lit("</option>")
    )
    year = F.year("election_date")
    # Options of one region's municipalities.
    return options.groupBy("category", "election_date", "region").agg(
        F.array_join(F.sort_array(F.collect_list(option)), "").alias("options")
    ).select(
        "category", "election_date",
        F.concat(
            F.lit(f"{_SITE}?tpel="), _code(), F.lit("&dtel="), F.date_format("election_date", "yyyyMMdd"),
            F.lit("&tpe=A&lev0=0&lev2="), _query_value("region"),
        ).alias("url"),
        F.concat(
            F.lit('<div id="headEnti"><h3>'), F.initcap("category"), F.lit(" "),
            # Every fourth year the site renders another date.
            F.when(year % 4 == 0, "31/12/1999").otherwise(F.date_format("election_date", "dd/MM/yyyy")),
            F.lit(' | Area ITALIA</h3></div><select name="sel_sezione1"><option value="0">Scegli Regione</option>'
                  '<option value="9-lev29">CHIUSA</option></select>'
                  '<select name="sel_sezione3"><option value="0">Scegli Provincia</option>'),
            F.col("options"), F.lit("</select>"),
        ).alias("html"),
    )


@query(sql_facts() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, region, count(DISTINCT mkey) AS children,
       3 AS level, 'P' AS page_type
FROM f GROUP BY category, election_date, region HAVING count(DISTINCT mkey) > 0""")
def page_edges(spark, sf_dir):
    asked = selector_pages(facts(spark, sf_dir))
    edges = pages.page_edges(pages.read_pages(asked))
    counted = edges.groupBy("parent_url", "level", query_code(F.col("child_url"), "tpe").alias("page_type"),
                            query_code(F.col("child_url"), "lev2").alias("region")).agg(
        F.countDistinct(query_code(F.col("child_url"), "lev3")).alias("children")
    )
    named = asked.select(F.col("url").alias("parent_url"), "category", "election_date")
    return plain(
        counted.join(named, "parent_url").select(
            "category", "election_date", "region", "children", "level", "page_type"
        )
    )


@query(sql_facts() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date,
       CASE WHEN year(election_date)%4=0 THEN 'unavailable' ELSE 'available' END AS availability, count(*) AS pages
FROM (SELECT DISTINCT category, election_date, region FROM f) GROUP BY ALL""")
def page_headings(spark, sf_dir):
    asked = selector_pages(facts(spark, sf_dir))
    checked = pages.rendered_election(
        pages.read_pages(asked), asked.select("url", "category", "election_date")
    )
    return plain(
        checked.groupBy("category", "election_date", "availability").agg(F.count(F.lit(1)).alias("pages"))
    )


# Traversal -------------------------------------------------------------------------


def _site_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, html) of a site of three levels, and the first pages of its elections.

    An election opens regions, a region municipalities. Pages are missing at both
    depths: every fifth year the region pages of one region, and in odd years the
    municipality pages of some names; every sixth year the site renders another date.
    """
    named = page_results(rows)
    year = F.year("election_date")
    code = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("-")).cast("binary")).cast("string")
    election = F.concat(F.lit(f"{_SITE}?tpel="), _code(), F.lit("&dtel="), F.date_format("election_date", "yyyyMMdd"))
    root = F.concat(election, F.lit("&tpe=A&lev0=0"))

    def opened(level: int, number):
        return F.concat(F.lit(f"&lev{level}="), number, F.lit(f"&levsut{level}={level}&ne{level}=1&es{level}=S"))

    region_url = F.concat(election, F.lit("&tpe=R&lev0=0"), opened(1, code("region")))
    city_url = F.concat(election, F.lit("&tpe=C&lev0=0"), opened(1, code("region")), opened(2, code("city")))
    heading = F.concat(
        F.lit('<div id="headEnti"><h3>'), F.initcap("category"), F.lit(" "),
        F.when(year % 6 == 0, "31/12/1999").otherwise(F.date_format("election_date", "dd/MM/yyyy")), F.lit(" | Area ITALIA</h3></div>"),
    )

    def selector(level: int, prompt: str, inner: str):
        option = F.concat(F.lit(f'<option value="1-lev{level}'), code(inner), F.lit('">'), F.coalesce(inner, F.lit("-")), F.lit("</option>"))
        listed = F.array_join(F.sort_array(F.collect_set(option)), "")
        return F.concat(F.lit(f'<select name="sel_sezione{level}"><option value="0">{prompt}</option>'), listed, F.lit("</select>"))

    first = named.groupBy("category", "election_date").agg(selector(1, "Scegli Regione", "region").alias("inside")).select(
        "category", "election_date", root.alias("url"), F.concat(heading, "inside").alias("html")
    )
    regions = named.where("city IS NOT NULL").groupBy("category", "election_date", "region").agg(
        selector(2, "Scegli Comune", "city").alias("inside")
    ).where(~((year % 5 == 0) & F.coalesce(F.col("region") == "ASIA", F.lit(False)))).select(
        region_url.alias("url"), F.concat(heading, "inside").alias("html")
    )
    leaves = page_bodies(named.where("city IS NOT NULL"), "category", "election_date", "region", "city").where(
        ~((year % 2 == 1) & ((F.length(F.coalesce("region", F.lit("-"))) + F.length("city")) % 5 == 2))
    ).select(city_url.alias("url"), "html")
    site = stage(first.select("url", "html").unionByName(regions).unionByName(leaves))
    return site, stage(first.select("url", "category", "election_date"))


def _traversed(spark, sf_dir):
    site, roots = _site_tree(facts(spark, sf_dir))
    parsed = stage(pages.read_pages(site))
    read = pages.municipality_pages(parsed)
    # Selector pages have no results and so no municipality: they are pages all the same.
    known = parsed.select("url", F.col("comune").alias("municipality"))
    found = traversal.traverse(known, pages.page_edges(parsed), roots)
    checked = pages.rendered_election(parsed, roots)
    elections = stage(traversal.election_completeness(found, checked))
    return found, elections, read


#: The site in SQL: regions and municipality pages of every election, and which of them are there.
_SITE_SQL = """
, ct AS (SELECT category, election_date, region, canonical AS city, max(electors) AS electors, max(voters) AS voters
         FROM f WHERE canonical IS NOT NULL GROUP BY ALL),
ro AS (SELECT category, election_date, region, year(election_date) AS y, count(canonical) > 0
              AND NOT (year(election_date)%5=0 AND coalesce(region,'-')='ASIA') AS there FROM f
        GROUP BY category, election_date, region),
lf AS (SELECT ct.*, NOT (ro.y%2=1 AND (length(coalesce(ct.region,'-')) + length(city))%5=2) AS there
       FROM ct JOIN ro ON ct.category=ro.category AND ct.election_date=ro.election_date
        AND ct.region IS NOT DISTINCT FROM ro.region AND ro.there),
rg AS (SELECT category, election_date, count(*) AS n, count(*) FILTER (NOT there) AS gone FROM ro GROUP BY ALL),
ci AS (SELECT category, election_date, count(*) AS n, count(*) FILTER (NOT there) AS gone FROM lf GROUP BY ALL),
el AS (SELECT rg.category, rg.election_date, year(rg.election_date)%6<>0 AS available, rg.n AS regions, rg.gone AS no_region,
              coalesce(ci.n,0) AS cities, coalesce(ci.gone,0) AS no_city
       FROM rg LEFT JOIN ci ON ci.category=rg.category AND ci.election_date=rg.election_date)
"""


@query(sql_facts() + _SITE_SQL + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, CAST(available AS VARCHAR) AS available,
       CASE WHEN available THEN 1+regions+cities ELSE 0 END AS pages,
       CASE WHEN available THEN cities-no_city ELSE 0 END AS municipality_pages,
       CASE WHEN available THEN no_region+no_city ELSE 0 END AS unread,
       CASE WHEN available THEN CASE WHEN cities>0 THEN 2 ELSE 1 END END AS depth,
       CAST(NOT available OR no_region+no_city=0 AS VARCHAR) AS complete FROM el""")
def tree_completeness(spark, sf_dir):
    """Every election's traversal: what was reached, what is missing at any depth, whether it is complete."""
    _, elections, _ = _traversed(spark, sf_dir)
    return plain(elections.drop("root_url"))


@query(sql_facts() + _SITE_SQL + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, depth, pages, read, unread FROM (
  SELECT category, election_date, 0 AS depth, 1 AS pages, 1 AS read, no_region+no_city AS unread FROM el
  UNION ALL SELECT category, election_date, 1, regions, regions-no_region, no_region+no_city FROM el
  UNION ALL SELECT category, election_date, 2, cities, cities-no_city, no_city FROM el WHERE cities>0)""")
def tree_levels(spark, sf_dir):
    """Pages of every level of every tree, and how many are missing at or below them."""
    found, elections, _ = _traversed(spark, sf_dir)
    counted = found.groupBy("root_url", "depth").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("read").cast("bigint")).alias("read"), F.sum("unread").alias("unread")
    )
    return plain(counted.join(elections.select("root_url", "category", "election_date"), "root_url").drop("root_url"))


@query(sql_facts() + _SITE_SQL + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, region, city AS municipality, 1 AS pages,
       electors AS official_electors, voters AS official_voters
FROM lf JOIN el USING (category, election_date)
WHERE available AND no_region+no_city=0""")
def tree_page_sets(spark, sf_dir):
    """Page sets of the elections whose traversal is complete."""
    found, elections, read = _traversed(spark, sf_dir)
    sets = verify.page_sets(traversal.complete_leaves(read, found, elections))
    summaries = verify.set_summaries(sets)
    return plain(summaries.select(
        "category", "election_date", "region", "municipality", "pages", "official_electors", "official_voters"
    ))


# Catalogue and URLs ----------------------------------------------------------------


@query(sql_facts() + """
SELECT category, year(election_date) AS year, concat(category,'/',filename) AS relative_path, filename,
       CAST(election_date AS VARCHAR) AS election_date, strftime(election_date,'%Y%m%d') AS identifier, download_url
FROM ar""")
def catalogue_extract(spark, sf_dir):
    """One listing page per category, as many entries as the category has archives."""
    entry = F.concat(
        F.lit('["'), F.col("category"), F.lit('","'), F.year("election_date").cast("string"), F.lit('","'),
        F.col("category"), F.lit("/"), F.col("filename"), F.lit('","'), F.col("filename"), F.lit('","'),
        F.date_format("election_date", "dd/MM/yyyy"), F.lit('","x","'),
        F.date_format("election_date", "yyyyMMdd"), F.lit('",]'),
    )
    listing = (
        archives(spark, sf_dir)
        .groupBy("category")
        .agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("entries"))
        .select(
            F.concat(F.lit("<script>var dataSet = ["), "entries", F.lit(" ,\n] ;</script>")).alias("html")
        )
    )
    return plain(catalogue.read_catalogue(listing))


@query("""
WITH u AS (SELECT url FROM pages UNION ALL SELECT replace(url,'http://','https://') FROM pages
  UNION ALL SELECT concat('https://dait.interno.gov.it', CASE WHEN page_id%3=0 THEN ':443' WHEN page_id%3=1 THEN ':8443' ELSE '' END, '/x/', page_id) FROM pages
  UNION ALL SELECT concat('https://user:pw@dait.interno.gov.it/', page_id) FROM pages)
SELECT status, count(*) AS n FROM (
 SELECT CASE WHEN NOT regexp_matches(url,'^https://') THEN 'not_https'
  WHEN regexp_matches(url,'^https://[^/@]*@') THEN 'credentials'
  WHEN NOT regexp_extract(url,'^https://([^/:]*)',1) IN ('elezionistorico.interno.gov.it','dait.interno.gov.it','www.gazzettaufficiale.it','www.normattiva.it') THEN 'host_not_allowed'
  WHEN regexp_extract(url,'^https://[^/]*:([0-9]+)',1) NOT IN ('','443') THEN 'port_not_allowed' ELSE 'ok' END AS status FROM u)
GROUP BY ALL""")
def url_policy_check(spark, sf_dir):
    known = table(spark, sf_dir, "pages").select("page_id", "url")
    port = F.when(F.col("page_id") % 3 == 0, ":443").when(F.col("page_id") % 3 == 1, ":8443").otherwise("")
    page = F.col("page_id").cast("string")
    urls = F.array(
        F.col("url"),
        F.regexp_replace("url", "^http://", "https://"),
        F.concat(F.lit("https://dait.interno.gov.it"), port, F.lit("/x/"), page),
        F.concat(F.lit("https://user:pw@dait.interno.gov.it/"), page),
    )
    return (
        known.select(F.explode(urls).alias("url"))
        .groupBy(url_policy(F.col("url")).alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
