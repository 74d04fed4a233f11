"""Queue, ledger, snapshot, export, manifest and registry queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.operators import colleges, coverage, facts as reads, layers, queue, registry_build, upsert
from urna.plans.audit_queries import TOTALS_SQL, UNITS_SQL, place_layers, stored_verifications
from urna.plans.election_view import archives, facts, sql_facts, stored_facts, table
from urna.plans.shape import plain
from urna.sinks import exports

QUERIES, ORACLE = {}, {}

def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# Queue and ledger ---------------------------------------------------------------

_QUEUE = """
qg AS (SELECT category, election_date, region, province, constituency, municipality AS label, canonical, place, round,
              max(voters) AS voters, count(DISTINCT college) AS c FROM f WHERE municipality IS NOT NULL GROUP BY ALL),
qi AS (SELECT category, election_date, coalesce(round,-1) AS round, place AS municipality_key, region, province,
              constituency, canonical AS municipality,
              least(voters//10000,100) + CASE WHEN canonical<>label OR c>1 THEN 1000 ELSE 0 END AS priority FROM qg),
qp AS (SELECT * FROM qi QUALIFY row_number() OVER (PARTITION BY category, election_date, round, municipality_key
         ORDER BY priority DESC, region NULLS FIRST, province NULLS FIRST, constituency NULLS FIRST, municipality) = 1),
qv AS (SELECT CASE WHEN votes%5=0 AND place LIKE 'p:%' THEN split_part(place,'|',2) ELSE place END AS vkey, category,
              election_date, votes%3=0 AS complete, concat('https://elezionistorico.interno.gov.it/?k=', place) AS url FROM b
       QUALIFY row_number() OVER (PARTITION BY vkey, category, election_date ORDER BY votes*100000+coalesce(electors,0) DESC) = 1),
qm AS (SELECT qp.* EXCLUDE (priority), priority + CASE WHEN category='camera' AND round=-1 THEN 5 ELSE 0 END AS priority,
              CASE WHEN category='camera' THEN 'failed' ELSE 'pending' END AS old_status,
              CASE WHEN category='camera' THEN 2 ELSE 0 END AS attempts FROM qp),
qb AS (SELECT qm.category, qm.election_date, split_part(municipality_key,'|',2) AS bare, count(*) AS n
       FROM qm GROUP BY ALL),
q AS (SELECT qm.* EXCLUDE (old_status), coalesce(CASE WHEN bv.complete THEN 'verified' WHEN NOT bv.complete THEN 'partial' END,
             CASE WHEN kv.complete THEN 'verified' WHEN NOT kv.complete THEN 'partial' END, old_status) AS status,
             coalesce(bv.url, kv.url) AS source_urls
      FROM qm LEFT JOIN qv kv ON kv.category=qm.category AND kv.election_date=qm.election_date AND kv.vkey=qm.municipality_key
      LEFT JOIN qb ON qb.category=qm.category AND qb.election_date=qm.election_date AND qb.bare=split_part(qm.municipality_key,'|',2) AND qb.n=1
      LEFT JOIN qv bv ON bv.category=qm.category AND bv.election_date=qm.election_date AND bv.vkey=qb.bare AND strpos(bv.vkey,':')=0)
"""


def _queue(spark, sf_dir) -> DataFrame:
    candidates = queue.queue_candidates(facts(spark, sf_dir))
    older = candidates.where(F.col("category") == "camera").select(
        *[c for c in candidates.columns if c != "priority"],
        (F.col("priority") + F.when(F.col("round") == -1, 5).otherwise(0)).alias("priority"),
        F.lit("failed").alias("status"),
        F.lit(2).cast("bigint").alias("attempts"),
    )
    stored = upsert.latest(
        stored_verifications(layers.best_layer(place_layers(spark, sf_dir))),
        ["verification_key", "category", "election_date"], ["verified_at"],
    )
    return queue.apply_verifications(queue.merge_queue(candidates, older), stored).drop("updated_at")


@query(sql_facts("," + UNITS_SQL + "," + _QUEUE) + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, round, municipality_key, region, province,
       constituency, municipality, priority, status, attempts, source_urls FROM q""")
def queue_seed(spark, sf_dir):
    return plain(_queue(spark, sf_dir))


@query(sql_facts("," + UNITS_SQL + "," + _QUEUE) + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, nullif(round,-1) AS round, municipality_key, region,
       province, constituency, municipality, priority, status, attempts, source_urls FROM q WHERE category='camera' AND status='partial'""")
def queue_list(spark, sf_dir):
    return plain(queue.list_queue(_queue(spark, sf_dir), category="camera", status="partial"))


_RUNS = """
re AS (SELECT CASE user_id%3 WHEN 0 THEN 'camera' WHEN 1 THEN 'senato' ELSE 'europee' END AS category,
              make_date(CAST(1995 + user_id%7 AS INTEGER),1,1) AS election_date,
              CASE event_id%7 WHEN 0 THEN 'running' WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' WHEN 3 THEN 'failed'
                   WHEN 4 THEN 'unavailable' ELSE 'partial' END AS status, ts, event_id FROM events),
rl AS (SELECT category, election_date, arg_max(status, event_id) AS status,
              coalesce(arg_max(ts, event_id) FILTER (status='running'), arg_min(ts, event_id)) AS started_at,
              CASE WHEN arg_max(status, event_id) IN ('complete','unavailable','failed') THEN arg_max(ts, event_id) END AS completed_at
       FROM re GROUP BY category, election_date)
"""


def _ledger(spark, sf_dir) -> DataFrame:
    """The ledger after two rounds of run events."""
    user = F.col("user_id")
    kind = F.col("event_id") % 7
    events = table(spark, sf_dir, "events").select(
        F.when(user % 3 == 0, "camera").when(user % 3 == 1, "senato").otherwise("europee").alias("category"),
        F.make_date((F.lit(1995) + user % 7).cast("int"), F.lit(1), F.lit(1)).alias("election_date"),
        F.when(kind == 0, "running").when(kind == 1, "complete").when(kind == 3, "failed")
        .when(kind == 4, "unavailable").otherwise("partial").alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("at"),
        F.col("event_id").alias("sequence"),
    )
    noon = F.col("sequence") < 500
    empty = events.where(F.lit(False)).select(
        "category", "election_date", "status", F.col("at").alias("started_at"), F.col("at").alias("completed_at")
    )
    return queue.ledger_merge(queue.ledger_merge(empty, events.where(noon)), events.where(~noon))


@query("WITH " + _RUNS.strip() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, status,
       strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS completed_at
FROM rl""")
def run_ledger(spark, sf_dir):
    def stamp(column: str):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)

    return plain(
        _ledger(spark, sf_dir).select(
            "category", "election_date", "status", stamp("started_at"), stamp("completed_at")
        )
    )


@query(sql_facts("," + _RUNS) + """
SELECT DISTINCT category, CAST(election_date AS VARCHAR) AS election_date FROM f
WHERE category IN ('camera','senato','europee') AND NOT EXISTS (SELECT 1 FROM rl WHERE rl.category=f.category
  AND rl.election_date=f.election_date AND rl.status IN ('complete','unavailable'))""")
def pending_elections(spark, sf_dir):
    imported = coverage.imported_elections(facts(spark, sf_dir), ("camera", "senato", "europee"))
    return plain(queue.pending_elections(imported, _ledger(spark, sf_dir)))


@query(sql_facts("," + UNITS_SQL + "," + TOTALS_SQL) + """
SELECT place, category, CAST(election_date AS VARCHAR) AS election_date, subject_key,
       CASE WHEN (length(place)+year(election_date))%3=0 THEN votes+1 ELSE votes END AS votes,
       CASE WHEN (length(place)+year(election_date))%3=0 THEN 'official_municipality_pages' ELSE 'open_data' END AS fonte
FROM t""")
def best_available(spark, sf_dir):
    placed = stored_facts(spark, sf_dir)
    chosen = layers.verification_layer(layers.layers(layers.fragment_units(placed)))
    rows = layers.subject_totals(layers.subject_units(placed), chosen).select(
        "place", "category", "election_date", "subject_key", "votes"
    )
    verified = (F.length("place") + F.year("election_date")) % 3 == 0
    official = rows.where(verified).withColumn("votes", F.col("votes") + 1)
    return plain(queue.best_available(rows, official))


@query("""
SELECT user_id AS source_url, max(struct_pack(ts, event_id)).event_id AS id,
       arg_max(event_type, (ts, event_id)) AS payload FROM events GROUP BY ALL""")
def latest_snapshot(spark, sf_dir):
    snapshots = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_url"), F.col("ts").alias("retrieved_at"),
        F.col("event_id").alias("id"), F.col("event_type").alias("payload"),
    )
    return upsert.latest_snapshots(snapshots).drop("retrieved_at")


@query("""
WITH o AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events WHERE value < 10 GROUP BY ALL),
n AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events WHERE value >= 10 GROUP BY ALL)
SELECT coalesce(n.user_id,o.user_id) AS user_id, coalesce(n.event_type,o.event_type) AS event_type,
       coalesce(n.event_id,o.event_id) AS event_id FROM o FULL OUTER JOIN n USING (user_id, event_type)""")
def upsert_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    key = ["user_id", "event_type"]
    stored = upsert.latest(rows.where(F.col("value") < 10), key, ["event_id"])
    incoming = upsert.latest(rows.where(F.col("value") >= 10), key, ["event_id"])
    return upsert.merge(stored, incoming, key, ["event_id"]).drop("value")


@query(sql_facts() + """
SELECT concat(category,'-',CAST(year(election_date) AS VARCHAR)) AS archive, count(DISTINCT source_file) AS files,
       count(*) AS rows, count(*) AS result_rows,
       count(*) FILTER (category='comunali' AND result_type='list' AND municipality IS NOT NULL) AS party_rows
FROM f GROUP BY category, election_date""")
def import_totals(spark, sf_dir):
    rows = facts(spark, sf_dir)
    raw = rows.select("archive", "category", "election_date", F.col("source_file").alias("file_name"))
    return coverage.import_totals(raw, rows, ["archive"])


# Exports -----------------------------------------------------------


def _sql_line(columns: list[str]) -> str:
    return "concat_ws(';'," + ",".join(f"coalesce(CAST({c} AS VARCHAR),'')" for c in columns) + ") AS line"


@query(sql_facts() + "SELECT " + _sql_line([
    "election_date", "region", "province", "municipality", "subject", "votes", "round", "NULL", "seats",
    "source_file", "source_row"]) + " FROM f WHERE category='comunali' AND result_type='list' AND municipality IS NOT NULL AND (round=1 OR round IS NULL)")
def csv_export_municipal(spark, sf_dir):
    rows = reads.municipal_output(reads.filter_municipal(facts(spark, sf_dir)))
    return exports.export_lines(rows, fv.MUNICIPAL_COLUMNS)


@query(sql_facts() + "SELECT " + _sql_line([
    "category", "election_date",
    "CASE WHEN municipality IS NOT NULL THEN 'comune' WHEN province IS NOT NULL THEN 'provincia' WHEN region IS NOT NULL THEN 'regione' WHEN country IS NOT NULL THEN 'nazione' ELSE 'nazionale' END",
    "region", "constituency", "province", "municipality", "country", "college", "round", "question_number",
    "n", "s", "e", "v", "vv", "concat('',files)", "fc", "download_url", "sha256"]) + """
FROM (SELECT f.category, f.election_date, region, constituency, province, municipality, country, college, round, question_number,
      count(*) AS n, count(DISTINCT subject_key) AS s, max(electors) AS e, max(voters) AS v, max(valid_votes) AS vv,
      string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS files, count(DISTINCT source_file) AS fc, ar.download_url, ar.sha256
      FROM f JOIN ar ON f.category=ar.category AND f.election_date=ar.election_date
      WHERE f.category IN ('camera','senato','europee','referendum') GROUP BY ALL)""")
def csv_export_coverage(spark, sf_dir):
    wanted = reads.filter_national(facts(spark, sf_dir))
    rows = coverage.national_coverage(wanted, archives(spark, sf_dir))
    return exports.export_lines(rows, fv.COVERAGE_COLUMNS)


# Scanned college tables ------------------------------------------------------------


def _sql_key(x: str) -> str:
    return f"regexp_replace(translate(upper({x}),'0158H$','OISBMS'),'[^A-Z]','','g')"


@query(f"""
WITH n AS (SELECT DISTINCT p_brand AS geography, p_name AS name, {_sql_key('p_name')} AS key FROM part),
s AS (SELECT DISTINCT p_type AS t, p_brand AS geography,
      concat(left(p_name, CAST(p_partkey % 5 AS INTEGER)), CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'X' ELSE 'QQ' END,
             substr(p_name, CAST(p_partkey % 5 + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS INTEGER))) AS text FROM part),
d AS (SELECT DISTINCT geography, text, {_sql_key('text')} AS target FROM s),
e AS (SELECT d.*, n.name AS exact FROM d LEFT JOIN n ON n.geography=d.geography AND n.key=d.target),
p AS (SELECT d.geography, d.text, n.name, n.key, round(1 - levenshtein(d.target, n.key)*1.0e0/greatest(length(d.target), length(n.key), 1), 9) AS score
      FROM d JOIN n USING (geography)),
r AS (SELECT geography, text, arg_max(name, (score, key)) AS name, max(score) AS score,
      (list(score ORDER BY score DESC))[2] AS rival FROM p GROUP BY ALL)
SELECT e.geography, e.text, CASE WHEN exact IS NOT NULL THEN exact
         WHEN r.score >= 0.75 AND coalesce(r.score - rival >= 0.05, true) THEN r.name END AS municipality,
       CASE WHEN exact IS NOT NULL THEN 1000 WHEN r.score >= 0.549999 THEN CAST(floor(r.score*1000 + 0.001) AS BIGINT) END AS score_permille
FROM e JOIN r ON r.geography=e.geography AND r.text=e.text""")
def fuzzy_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    cut = (key % 5).cast("int")
    typo = F.concat(
        F.substring(F.col("p_name"), F.lit(1), cut),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "X").otherwise("QQ"),
        F.col("p_name").substr(cut + F.when(key % 4 == 0, 2).otherwise(1), F.length("p_name")),
    )
    scanned = part.select(F.col("p_brand").alias("geography"), typo.alias("text"))
    names = part.select(F.col("p_brand").alias("geography"), F.col("p_name").alias("name")).distinct()
    found = colleges.accepted_names(colleges.match_names(scanned, names))
    return found.select(
        "geography", "text", "municipality",
        F.floor(F.col("score") * 1000 + 0.001).cast("bigint").alias("score_permille"),
    )


def _words(spark, sf_dir) -> DataFrame:
    """Conversation words placed on pages: one turn is one printed line."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(
        F.col("conv_id").alias("page"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
        F.col("turn").alias("line_num"), F.posexplode(F.split("text", " ")).alias("word_num", "text"),
    )
    return words.select(
        "page", "block_num", "par_num", "line_num", "word_num", "text",
        (F.col("word_num") * 90 + 300).alias("left"),
        (F.col("line_num") * 40 + F.col("line_num") % 7 * 30 + F.col("word_num") % 5).alias("top"),
        F.lit(20).alias("height"), F.lit(5).alias("level"), F.lit(90.0).alias("conf"),
    ).where(F.trim("text") != "")


_WORDS_SQL = """
WITH s AS (SELECT conv_id AS page, turn AS line_num, string_split(text,' ') AS w FROM conversations),
x AS (SELECT page, line_num, unnest(w) AS text, generate_subscripts(w,1)-1 AS pos FROM s),
w AS (SELECT *, pos*90+300 AS x, line_num*40 + line_num%7*30 + pos%5 AS top FROM x WHERE trim(text) <> ''),
l AS (SELECT page, line_num, min(top) AS top, max(top)+20 AS bottom,
      coalesce(string_agg(text,' ' ORDER BY x) FILTER (x < 780),'') AS number_text,
      coalesce(string_agg(text,' ' ORDER BY x) FILTER (x >= 780),'') AS text FROM w GROUP BY ALL)
"""


@query(_WORDS_SQL + "SELECT page, line_num, top, bottom, number_text, text FROM l")
def ocr_lines(spark, sf_dir):
    return plain(
        colleges.page_lines(_words(spark, sf_dir)).select(
            "page", "line_num", "top", "bottom", "number_text", "text"
        )
    )


@query(_WORDS_SQL + """,
k AS (SELECT page, line_num, top, top - lag(top) OVER (PARTITION BY page ORDER BY top, line_num) AS step FROM l),
m AS (SELECT page, coalesce(median(step), 38) AS spacing FROM k GROUP BY ALL),
nb AS (SELECT l.page, l.line_num, arg_min(n.line_num, n.line_num) AS number FROM l
       JOIN l n ON n.page=l.page AND abs(n.line_num*43 - l.top) < 25 GROUP BY ALL)
SELECT k.page, k.line_num, nb.number, CAST(step IS NULL OR step > 1.6*spacing AS VARCHAR) AS gap,
       CAST(coalesce(step > 2.4*spacing, false) AS VARCHAR) AS wide_gap
FROM k JOIN m USING (page) LEFT JOIN nb ON nb.page=k.page AND nb.line_num=k.line_num""")
def ocr_layout(spark, sf_dir):
    lines = colleges.page_lines(_words(spark, sf_dir))
    numbers = lines.select(
        "page", (F.col("line_num") * 43).alias("top"), F.col("line_num").alias("number"),
        F.struct("line_num").alias("position"),
    )
    laid = colleges.nearby_numbers(colleges.line_gaps(lines), numbers)
    return plain(laid.select("page", "line_num", "number", "gap", "wide_gap"))


@query("""
WITH o AS (SELECT DISTINCT upper(p_name) AS name, p_type AS geography FROM part),
v AS (SELECT p_size AS section, geography, count(*) AS n, min(p_partkey) AS pos FROM part JOIN o ON o.name=upper(p_name) GROUP BY ALL)
SELECT section::BIGINT AS section, arg_max(geography, (n, -pos, geography)) AS geography, max(n) AS votes FROM v GROUP BY section""")
def majority_geography(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    owners = colleges.name_owners(part.select(F.col("p_name").alias("name"), F.col("p_type").alias("geography")))
    entries = part.select(
        F.col("p_size").alias("section"), F.col("p_partkey").alias("position"), F.upper("p_name").alias("name")
    )
    return plain(colleges.majority_geography(entries, owners))


@query("""
SELECT p_type AS geography, upper(p_name) AS name, count(DISTINCT p_brand) AS colleges
FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1""")
def split_city_index(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return colleges.split_cities(
        part.select(F.col("p_type").alias("geography"), F.col("p_name").alias("name"), F.col("p_brand").alias("college"))
    )


@query("""
WITH i AS (SELECT *, lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR before<>p_type THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS island FROM i)
SELECT p_brand AS map_version, p_partkey AS section, p_type AS geography,
       coalesce(sum(p_size) OVER (PARTITION BY p_brand, island ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS "offset"
FROM s""")
def merge_sections(spark, sf_dir):
    sections = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("map_version"), F.col("p_partkey").alias("section"),
        F.col("p_type").alias("geography"), F.col("p_size").alias("last_college"),
    )
    return colleges.merge_sections(sections).select("map_version", "section", "geography", "offset")


@query("""
WITH k AS (SELECT p_brand AS college, p_partkey AS line_no, p_partkey%6 AS kind, upper(p_name) AS n,
     max(CASE WHEN p_partkey%6=3 THEN p_partkey END) OVER w AS opened, max(CASE WHEN p_partkey%6=2 THEN p_partkey END) OVER w AS broken
     FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT college, line_no, CASE WHEN kind=2 THEN 'whole' ELSE 'zone' END AS kind,
       CASE kind WHEN 0 THEN concat('RM-',n) WHEN 1 THEN concat('PARMA-',n) ELSE n END AS name,
       CASE WHEN kind=0 THEN 'RM' END AS code, CASE WHEN kind=1 THEN 'PARMA' END AS prefix,
       CASE WHEN kind<>2 THEN n END AS zone
FROM k WHERE kind=2 OR (kind IN (0,1,5) AND NOT coalesce(opened > coalesce(broken,-1), false))""")
def entry_classify(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind, name = F.col("p_partkey") % 6, F.upper("p_name")
    line = (
        F.when(kind == 0, F.concat(F.lit("( RM-"), name, F.lit(" )")))
        .when(kind == 1, F.concat(F.lit("{ PARMA-"), name, F.lit(" )")))
        .when(kind == 2, name)
        .when(kind == 3, F.concat(F.lit("Comprende il territorio di "), F.col("p_name")))
        .when(kind == 4, F.col("p_name"))
        .otherwise(F.concat(F.lit("( "), name, F.lit(" )")))
    )
    lines = part.select(F.col("p_brand").alias("college"), F.col("p_partkey").alias("line_no"), line.alias("line"))
    return colleges.line_entries(lines, "college").drop("raw")


def _decree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Decree lines of every kind from all parts, and the names open data would hold."""
    part = table(spark, sf_dir, "part")
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 11
    plain_name = F.upper(F.concat(F.replace("p_name", F.lit(" ")), F.col("p_type")))
    name = (
        F.when((key % 13 == 0) & F.col("p_type").isin("LARGE", "ECONOMY"), "ROMA")
        .when((key % 13 == 1) & F.col("p_type").isin("MEDIUM", "LARGE"), "BOLOGNA")
        .when((key % 13 == 2) & (F.col("p_type") == "SMALL"), "PADOVA")
        .when((key % 13 == 2) & (F.col("p_type") == "PROMO"), "PRATO")
        .otherwise(plain_name)
    )
    named = part.withColumn("n", name).withColumn("zone", F.concat(F.lit("ZONA "), F.char((F.col("p_size") % 8 + 65).cast("bigint"))))
    typo = F.concat(F.substring("n", 1, 2), F.col("n").substr(F.lit(4), F.length("n")))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = (
        F.when(kind == 0, say("( RM-", F.col("zone"), " )"))
        .when(kind == 1, say(F.col("n"), "-", F.replace("zone", F.lit(" "), F.lit("."))))
        .when(kind == 2, F.col("n"))
        .when(kind == 3, typo)
        .when(kind == 4, say("( ", F.col("zone"), " )"))
        .when(kind == 5, say("PO-", F.col("zone")))
        .when(kind == 6, say("Comprende parte del territorio del comune di ", F.col("n"), ", delimitata"))
        .when(kind == 7, say(typo, "-", F.replace("zone", F.lit(" "), F.lit("."))))
        .when(kind == 8, say("Comprende i seguenti comuni: ", F.lower("n"), " e ", F.lower(plain_name), "."))
        .when(kind == 9, say("Comprende il comune di ", typo, ", intero"))
        .otherwise(say("B0-", F.col("zone")))
    )
    version = F.when(key % 2 == 0, "camera-1993").otherwise("senato-1993").alias("map_version")
    lines = named.select(
        version, (F.ascii("p_type") * 10 + F.col("p_size") % 5).alias("section"), (key % 7 % 3 + 1).cast("int").alias("college"),
        F.floor(key / 500).cast("int").alias("page"), key.alias("line_no"), line.alias("line"),
    )
    split = ~F.col("p_name").startswith("old") & ~F.col("p_name").startswith("cold") & (F.col("n") != "PRATO")
    reference = named.select(version, F.col("p_type").alias("geography"), F.col("n").alias("name"), F.when(split, F.col("p_brand")).alias("college"))
    return lines, reference


@query(f"""
WITH pn AS (SELECT *, upper(concat(replace(p_name,' ',''), p_type)) AS pl FROM part),
nm AS (SELECT *, CASE WHEN p_partkey%2=0 THEN 'camera-1993' ELSE 'senato-1993' END AS map_version, p_partkey%11 AS kind,
        CASE WHEN p_partkey%13=0 AND p_type IN ('LARGE','ECONOMY') THEN 'ROMA' WHEN p_partkey%13=1 AND p_type IN ('MEDIUM','LARGE') THEN 'BOLOGNA'
             WHEN p_partkey%13=2 AND p_type='SMALL' THEN 'PADOVA' WHEN p_partkey%13=2 AND p_type='PROMO' THEN 'PRATO' ELSE pl END AS n,
        concat('ZONA ', chr(CAST(p_size%8+65 AS INTEGER))) AS zone FROM pn),
ln AS (SELECT *, ascii(p_type)*10 + p_size%5 AS section, CAST(p_partkey%7%3+1 AS INTEGER) AS college, p_partkey//500 AS page, p_partkey AS line_no,
        concat(left(n,2), substr(n,4)) AS typo FROM nm),
tx AS (SELECT *, CASE kind WHEN 0 THEN concat('( RM-',zone,' )') WHEN 1 THEN concat(n,'-',replace(zone,' ','.')) WHEN 2 THEN n WHEN 3 THEN typo
        WHEN 4 THEN concat('( ',zone,' )') WHEN 5 THEN concat('PO-',zone) WHEN 6 THEN concat('Comprende parte del territorio del comune di ',n,', delimitata')
        WHEN 7 THEN concat(typo,'-',replace(zone,' ','.')) WHEN 8 THEN concat('Comprende i seguenti comuni: ',lower(n),' e ',lower(pl),'.')
        WHEN 9 THEN concat('Comprende il comune di ',typo,', intero') ELSE concat('B0-',zone) END AS line FROM ln),
co AS (SELECT map_version, section, college, string_agg(line,' ' ORDER BY line_no) AS prose, arg_min(page, line_no) AS page FROM tx GROUP BY ALL),
ws AS (SELECT map_version, section, college, line_no, u.name, u.raw, row_number() OVER (PARTITION BY map_version, section, college ORDER BY line_no, u.i) AS pos
       FROM tx, LATERAL (SELECT unnest([n, pl]) AS name, unnest([lower(n), lower(pl)]) AS raw, unnest([1,2]) AS i) u WHERE kind=8),
ds AS (SELECT map_version, section, college, name, arg_min(raw, (pat, line_no)) AS raw, min((pat, line_no)) AS o FROM (
        SELECT *, CASE kind WHEN 9 THEN 1 ELSE 2 END AS pat, CASE kind WHEN 9 THEN typo ELSE n END AS name,
               CASE kind WHEN 9 THEN concat('Comprende il comune di ',typo) ELSE concat('parte del territorio del comune di ',n) END AS raw
        FROM tx WHERE kind IN (6,9)) GROUP BY ALL),
op AS (SELECT *, max(CASE WHEN kind IN (6,8,9) THEN line_no END) OVER w AS opened,
              max(CASE WHEN kind NOT IN (0,4,6,8,9) THEN line_no END) OVER w AS broken
       FROM tx WINDOW w AS (PARTITION BY map_version, section, college ORDER BY line_no)),
en AS (SELECT map_version, section, college, co.page, 0 AS part, ws.pos AS pos, 'whole' AS kind, ws.name, ws.raw, '' AS description,
              NULL AS code, NULL AS prefix, NULL AS zone FROM ws JOIN co USING (map_version, section, college)
       UNION ALL SELECT map_version, section, college, co.page, 1, row_number() OVER (PARTITION BY map_version, section, college ORDER BY o), 'described_part',
              ds.name, ds.raw, co.prose, NULL, NULL, NULL FROM ds JOIN co USING (map_version, section, college)
       UNION ALL SELECT map_version, section, college, page, 2, line_no, CASE WHEN kind IN (2,3) THEN 'whole' ELSE 'zone' END,
              CASE kind WHEN 0 THEN concat('RM-',zone) WHEN 4 THEN zone ELSE line END, line, '',
              CASE kind WHEN 0 THEN 'RM' WHEN 5 THEN 'PO' WHEN 10 THEN 'B0' END, CASE kind WHEN 1 THEN n WHEN 7 THEN typo END,
              CASE WHEN kind IN (1,7) THEN replace(zone,' ','.') WHEN kind IN (0,4,5,10) THEN zone END
       FROM op WHERE kind IN (1,2,3,5,7,10) OR (kind IN (0,4) AND NOT coalesce(opened > coalesce(broken,-1), false))),
rf AS (SELECT DISTINCT map_version, p_type AS geography, n AS name,
              CASE WHEN p_name LIKE 'old%' OR p_name LIKE 'cold%' OR n='PRATO' THEN '' ELSE p_brand END AS college FROM nm),
nn AS (SELECT map_version, geography, name, count(DISTINCT college) > 1 AS split FROM rf GROUP BY ALL),
vt AS (SELECT map_version, section, geography, count(*) AS v, min((college, part, pos)) AS first FROM en JOIN nn USING (map_version, name) GROUP BY ALL),
mj AS (SELECT map_version, section, geography FROM vt QUALIFY row_number() OVER (PARTITION BY map_version, section ORDER BY v DESC, first, geography DESC) = 1),
sc AS (SELECT map_version, section, geography, max(college) AS last, lag(geography) OVER (PARTITION BY map_version ORDER BY section) AS before
       FROM en JOIN mj USING (map_version, section) GROUP BY map_version, section, geography),
si AS (SELECT *, sum(CASE WHEN before IS NULL OR before<>geography THEN 1 ELSE 0 END) OVER (PARTITION BY map_version ORDER BY section) AS island FROM sc),
so AS (SELECT map_version, section, geography, coalesce(sum(last) OVER (PARTITION BY map_version, island ORDER BY section
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM si),
pl AS (SELECT en.*, so.geography, so.off, {_sql_key('en.name')} AS tk, {_sql_key('prefix')} AS pk FROM en JOIN so USING (map_version, section)),
kn AS (SELECT map_version, geography, {_sql_key('name')} AS k, max(name) AS name, split FROM nn GROUP BY ALL),
lk AS (SELECT map_version, geography, true AS split, k, name FROM kn WHERE split
       UNION ALL SELECT map_version, geography, false, k, max(name) FROM kn GROUP BY map_version, geography, k),
tg AS (SELECT DISTINCT map_version, geography, tk AS t FROM pl UNION SELECT DISTINCT map_version, geography, pk FROM pl WHERE pk IS NOT NULL),
pr AS (SELECT tg.map_version, tg.geography, t, split, name, k, 1.0e0 - levenshtein(t, k)*1.0e0/greatest(length(t), length(k), 1) AS score
       FROM tg JOIN lk USING (map_version, geography) WHERE t<>''),
mt AS (SELECT map_version, geography, t, split, max(CASE WHEN t=k THEN name END) AS exact, arg_max(name, (score, k)) AS name, max(score) AS score,
              (list(score ORDER BY score DESC))[2] AS rival FROM pr WHERE score >= 0.55e0 - 1.0e-9 GROUP BY ALL),
ms AS (SELECT map_version, geography, t, split, CASE WHEN exact IS NOT NULL THEN exact WHEN coalesce(score - rival >= 0.05e0, true) THEN name END AS name,
              CASE WHEN exact IS NOT NULL THEN 1.0e0 ELSE score END AS score FROM mt),
ge AS (SELECT map_version, geography, CASE WHEN count(*)=1 THEN max(name) END AS sole, bool_or(name='PRATO') AS prato FROM nn
       WHERE split AND name IN ('ROMA','BOLOGNA','PADOVA','PRATO') GROUP BY ALL),
zc AS (SELECT pl.*, sole, CASE WHEN pl.kind='zone' THEN CASE
          WHEN prefix IS NOT NULL THEN CASE WHEN sp.score >= 0.95e0 AND sp.name IS NOT NULL THEN sp.name ELSE (SELECT x.name FROM lk x WHERE NOT x.split AND x.map_version=pl.map_version
               AND x.geography=pl.geography AND x.k=pk) END
          ELSE (SELECT y.name FROM nn y WHERE y.split AND y.map_version=pl.map_version AND y.geography=pl.geography
               AND y.name=CASE code WHEN 'RM' THEN 'ROMA' WHEN 'B0' THEN 'BOLOGNA' WHEN 'PO' THEN CASE WHEN coalesce(prato,false) THEN 'PRATO' ELSE 'PADOVA' END END) END END AS direct,
          CASE WHEN prefix IS NULL THEN true ELSE coalesce(sp.score >= 0.95e0 AND sp.name IS NOT NULL, false) END AS is_split
       FROM pl LEFT JOIN ge USING (map_version, geography)
       LEFT JOIN ms sp ON sp.split AND sp.map_version=pl.map_version AND sp.geography=pl.geography AND sp.t=pk),
cr AS (SELECT *, last_value(CASE WHEN direct IS NOT NULL THEN {{'d': direct, 's': is_split}} END IGNORE NULLS) OVER
       (PARTITION BY map_version, section, college ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM zc),
ct AS (SELECT *, CASE WHEN kind='zone' THEN CASE WHEN prefix IS NOT NULL THEN direct
              ELSE coalesce(direct, CASE WHEN coalesce(c.s, false) THEN c.d ELSE sole END) END END AS city FROM cr),
fn AS (SELECT ct.*, CASE WHEN ct.kind='zone' AND city IS NULL THEN 'whole' ELSE ct.kind END AS entry_type, a.name AS an, coalesce(a.score,0) AS ascore,
              s.name AS sn, s.score AS sscore
       FROM ct LEFT JOIN ms a ON NOT a.split AND a.map_version=ct.map_version AND a.geography=ct.geography AND a.t=tk
       LEFT JOIN ms s ON s.split AND s.map_version=ct.map_version AND s.geography=ct.geography AND s.t=tk),
fs AS (SELECT *, CASE WHEN city IS NOT NULL THEN 1.0e0 WHEN kind='described_part' AND sn IS NOT NULL THEN CASE WHEN sscore >= 0.6e0 THEN 1.0e0 ELSE 0.0e0 END
              ELSE ascore END AS sco, CASE WHEN city IS NOT NULL THEN city WHEN kind='described_part' AND sn IS NOT NULL THEN sn ELSE an END AS mu FROM fn)
SELECT map_version, geography, CAST(college + off AS BIGINT) AS college, CASE WHEN sco >= 0.75e0 THEN coalesce(mu,'') ELSE '' END AS municipality, entry_type,
       CASE WHEN entry_type='zone' THEN coalesce(zone,'') ELSE description END AS entry_text, page AS source_page, trim(raw) AS ocr_text,
       CAST(floor(sco*1000+0.5) AS BIGINT) AS match_permille FROM fs""")
def registry_rows(spark, sf_dir):
    rows = registry_build.registry_rows(*_decree(spark, sf_dir))
    return plain(rows.withColumn("match_permille", F.round(F.col("match_score") * 1000).cast("bigint")).drop("match_score"))


@query("""
SELECT p_partkey AS college, 'whole' AS kind, unnest([upper(p_name), upper(p_type), 'GAMMA']) AS name FROM part
UNION ALL SELECT p_partkey, 'described_part', 'BRAND' FROM part""")
def prose_entries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    texts = F.array(
        F.concat(F.lit("Comprende i seguenti comuni: "), F.col("p_name"), F.lit(", "), F.lower("p_type")),
        F.concat(F.lit("e gamma nonchè parte del territorio del"),),
        F.concat(F.lit("comune di "), F.col("p_brand"), F.lit(", delimitata come segue")),
    )
    lines = part.select(F.col("p_partkey").alias("college"), F.posexplode(texts).alias("line_no", "line"))
    return colleges.prose_entries(lines, "college").drop("raw")
