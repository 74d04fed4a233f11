"""Orders, exports, manifests and stored tables: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.numbers import parse_italian_float
from urna.operators import closure, colleges, coverage, facts as reads, queue, upsert
from urna.plans.audit_queries import UNITS_SQL
from urna.plans.election_view import archives, facts, sql_facts, sql_slug, stored_facts, table
from urna.plans.shape import plain
from urna.plans.verify_queries import _TREE, _tree
from urna.plans.work_queries import _QUEUE, _RUNS, _ledger, _queue, _words
from urna.session import discard, shared_folder, stage
from urna.sinks import exports, manifest as digests, store, tables
from urna.sources import registry

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Orders ---------------------------------------------------------------------------


def _sql_order(columns) -> str:
    return ", ".join(f"{c} NULLS FIRST" for c in columns)


@query(sql_facts() + f"""
SELECT row_number() OVER (ORDER BY {_sql_order(reads.RESULT_ORDER)}) AS position,
       category, CAST(election_date AS VARCHAR) AS election_date, subject, votes, source_file, source_row FROM f""")
def history_positions(spark, sf_dir):
    """The place of every row of the view in the order of its pages."""
    rows = reads.numbered(facts(spark, sf_dir), reads.RESULT_ORDER)
    return plain(rows.select("position", "category", "election_date", "subject", "votes", "source_file", "source_row"))


@query(sql_facts() + f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY {_sql_order(reads.RESULT_ORDER)}) AS position,
       category, CAST(election_date AS VARCHAR) AS election_date, subject, votes, source_file, source_row FROM f)
WHERE position > 999 * 5 AND position <= 1000 * 5""")
def history_page_deep(spark, sf_dir):
    """Page 1,000 of the whole view, of five rows a page."""
    rows = reads.numbered_page(facts(spark, sf_dir), reads.RESULT_ORDER, limit=5, offset=999 * 5)
    return plain(rows.select("position", "category", "election_date", "subject", "votes", "source_file", "source_row"))


_COVERAGE_KEYS = (
    "category", "election_date", "region", "province", "municipality", "constituency", "college", "source_file", "round", "question_number",
)


@query(sql_facts() + f"""
SELECT row_number() OVER (ORDER BY {_sql_order(reads.COVERAGE_ORDER)}) AS position, category, CAST(election_date AS VARCHAR) AS election_date,
       region, province, municipality, constituency, college, source_file, round, question_number, n
FROM (SELECT {", ".join(_COVERAGE_KEYS)}, count(*) AS n FROM f GROUP BY ALL)""")
def coverage_order(spark, sf_dir):
    """Every geography and file at its place in the order of the coverage list."""
    rows = facts(spark, sf_dir).groupBy(*_COVERAGE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return plain(reads.numbered(rows, reads.COVERAGE_ORDER).select("position", *_COVERAGE_KEYS, "n"))


@query(sql_facts() + """
SELECT row_number() OVER (ORDER BY election_date, region NULLS FIRST, province NULLS FIRST, municipality, subject, source_row) AS position,
       CAST(election_date AS VARCHAR) AS data, region AS regione, province AS provincia, municipality AS comune, subject AS partito,
       votes AS voti, source_row AS fonte_riga
FROM f WHERE category='comunali' AND result_type='list' AND municipality IS NOT NULL AND (round=1 OR round IS NULL)""")
def municipal_order(spark, sf_dir):
    """Municipal party rows at their places in the order of that list."""
    rows = reads.numbered(reads.filter_municipal(facts(spark, sf_dir)), reads.MUNICIPAL_ORDER)
    named = reads.municipal_output(rows).columns
    out = rows.select("position", *[F.col(c).alias(n) for c, n in (
        ("election_date", "data"), ("region", "regione"), ("province", "provincia"), ("municipality", "comune"),
        ("party", "partito"), ("votes", "voti"), ("source_row", "fonte_riga"),
    ) if n in named])
    return plain(out)


@query(sql_facts() + """
SELECT row_number() OVER (ORDER BY category, election_date, lower(comune), comune, mkey) AS position, category,
       CAST(election_date AS VARCHAR) AS election_date, comune, mkey AS municipality_key
FROM (SELECT DISTINCT category, election_date, CASE WHEN votes%3=0 THEN lower(municipality) ELSE municipality END AS comune, mkey
      FROM f WHERE municipality IS NOT NULL)""")
def municipality_list_order(spark, sf_dir):
    """Names in mixed case at their places in the list's order, which does not regard ASCII case."""
    rows = facts(spark, sf_dir).where(F.col("municipality").isNotNull()).select(
        "category", "election_date",
        F.when(F.col("votes") % 3 == 0, F.lower("municipality")).otherwise(F.col("municipality")).alias("comune"), "municipality_key",
    ).distinct()
    return plain(reads.numbered(rows, coverage.nocase_keys()).select("position", "category", "election_date", "comune", "municipality_key"))


@query(sql_facts("," + UNITS_SQL + "," + _QUEUE) + """
SELECT row_number() OVER (ORDER BY priority DESC, election_date, category, municipality, round, municipality_key) AS position,
       category, CAST(election_date AS VARCHAR) AS election_date, round, municipality_key, municipality, priority, status FROM q""")
def queue_order(spark, sf_dir):
    """Every queue item at its place by urgency."""
    ties = ("round", "municipality_key")
    rows = reads.numbered(_queue(spark, sf_dir), (*queue.urgency(), *ties))
    return plain(rows.select("position", "category", "election_date", "round", "municipality_key", "municipality", "priority", "status"))


@query(sql_facts("," + _RUNS) + """
SELECT row_number() OVER (ORDER BY election_date, category) AS position, category, CAST(election_date AS VARCHAR) AS election_date
FROM (SELECT DISTINCT category, election_date FROM f WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.category=f.category
      AND rl.election_date=f.election_date AND rl.status IN ('complete','unavailable')) ORDER BY election_date, category LIMIT 5)""")
def next_elections(spark, sf_dir):
    """The five elections that a worker would take next, in order."""
    pending = queue.pending_elections(facts(spark, sf_dir), _ledger(spark, sf_dir))
    rows = reads.numbered(queue.next_elections(pending, 5), ("election_date", "category"))
    return plain(rows.select("position", "category", "election_date"))


# Exports --------------------------------------------------------------------------


def _percent(part: str, whole: str) -> str:
    """100 * part / whole at six digits, half-even, as its shortest text."""
    whole = f"nullif({whole},0)"
    q, r = f"(({part})*100000000 // {whole})", f"(({part})*100000000 % {whole})"
    up = f"CASE WHEN 2*{r} > {whole} OR (2*{r} = {whole} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST(({q} + {up}) / 1000000.0::DOUBLE AS VARCHAR)"


_HISTORY_LINE = "concat_ws(';'," + ",".join(f"coalesce(CAST({c} AS VARCHAR),'')" for c in (
    "f.category", "f.election_date", "round", "region", "constituency", "province", "municipality",
    f"CASE WHEN municipality IS NOT NULL AND province IS NOT NULL THEN concat(CAST(f.election_date AS VARCHAR),'|',{sql_slug('province')},'|',{sql_slug('municipality')}) END",
    "CASE WHEN municipality IS NULL THEN 'non_municipal' WHEN province IS NOT NULL AND region IS NOT NULL THEN 'region_province_municipality' "
    "WHEN province IS NOT NULL THEN 'province_municipality' WHEN region IS NOT NULL THEN 'region_municipality_incomplete' ELSE 'municipality_incomplete' END",
    "country", "college", "question_number", "NULL", "result_type", "subject", "CASE WHEN result_type='list' THEN subject END",
    "CASE WHEN result_type<>'list' THEN subject END", "NULL", "votes", _percent("votes", "valid_votes"), "seats", "electors", "NULL", "voters",
    "NULL", _percent("voters", "electors"), "valid_votes", "NULL", "NULL", "blank_ballots", "NULL", "NULL", "download_url", "source_file",
    "source_row", "ar.sha256",
)) + ")"


def _history(spark, sf_dir) -> DataFrame:
    return reads.result_rows(reads.with_archive(facts(spark, sf_dir), archives(spark, sf_dir)))


@query(sql_facts() + f"SELECT {_HISTORY_LINE} AS line FROM f JOIN ar ON f.category=ar.category AND f.election_date=ar.election_date")
def csv_export_history(spark, sf_dir):
    """The full export: 36 columns of every row."""
    return exports.export_lines(_history(spark, sf_dir), fv.RESULT_COLUMNS)


@query(sql_facts() + f"""
, l AS (SELECT {_HISTORY_LINE} AS line FROM f JOIN ar ON f.category=ar.category AND f.election_date=ar.election_date)
SELECT line, CAST(false AS VARCHAR) AS header, true::VARCHAR AS in_order FROM l
UNION ALL SELECT '{";".join(c.upper() for c in fv.RESULT_COLUMNS)}', 'true', 'true'""")
def csv_export_files(spark, sf_dir):
    """The full export as files, read back: the header once, in the first file, and files in the order of their rows.

    The reader drops the mark in front of the header; a test looks at the bytes.
    """
    path = _folder(spark, "export")
    # Written first: the sort reads its rows twice, and the joins' shuffle files are gone by then.
    rows = stage(reads.with_archive(facts(spark, sf_dir).drop("municipality_key", "subject_key"), archives(spark, sf_dir)))
    exports.write_results(rows, path)
    discard(rows)
    lines = exports.read_export(spark, path)
    fields = F.split("line", ";", 3)
    date = F.when(F.col("file") > 0, fields[1])
    ranges = stage(lines.groupBy("file").agg(F.min(date).alias("least"), F.max(date).alias("most")))
    # A file's dates must not come before those of any earlier file: a few rows, one a file.
    later = ranges.alias("b").join(ranges.alias("a"), F.col("a.file") < F.col("b.file"))
    bad = later.where(F.col("a.most") > F.col("b.least")).select(F.col("b.file").alias("file")).distinct().withColumn("wrong", F.lit(True))
    return plain(lines.join(F.broadcast(bad), "file", "left").select(
        "line", (F.col("file") == 0).alias("header"), F.col("wrong").isNull().alias("in_order")
    ))


@query("""
SELECT concat('{"event_id":', event_id, ',"payload":{"kind":"', event_type, '","user":"', user_id, '"},"tags":["', event_type, '"]}') AS line FROM events""")
def json_payloads(spark, sf_dir):
    """Payload maps and lists as JSON lines."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("payload"),
        F.array("event_type").alias("tags"),
    )
    return exports.payload_lines(rows)


# Manifests ------------------------------------------------------------------------

#: Columns of the tables, and the column each is partitioned by here.
_SCHEMAS = {
    "region": ("r_regionkey r_name", "r_name"),
    "nation": ("n_nationkey n_name n_regionkey", "n_regionkey"),
    "customer": ("c_custkey c_name c_nationkey c_acctbal:float c_mktsegment", "c_mktsegment"),
    "supplier": ("s_suppkey s_name s_nationkey s_acctbal:float", "s_nationkey"),
    "part": ("p_partkey p_name p_brand p_type p_size p_retailprice:float", "p_brand"),
    "orders": ("o_orderkey o_custkey o_orderstatus o_totalprice:float o_orderdate:time o_orderpriority", "o_orderpriority"),
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:float l_extendedprice:float l_discount:float l_tax:float "
        "l_returnflag l_linestatus l_shipdate:time", "l_returnflag"),
    "events": ("event_id ts:time user_id event_type value:float props", "event_type"),
    "documents": ("doc_id text lang source n_chars", "lang"),
    "embeddings": ("vec_id embedding:floats label", "label"),
    "pages": ("page_id url html", None),
    "benchmark": ("item_id text", None),
    "labels": ("doc_id quality toxic", "quality"),
    "conversations": ("conv_id turn role text", "role"),
}


def _sql_text(column: str, kind: str) -> str:
    """A value as the manifest writes it."""
    number = lambda x: (
        f"concat(floor({x}::DOUBLE*1048576)::BIGINT, '/', "
        f"floor(({x}::DOUBLE*1048576 - floor({x}::DOUBLE*1048576))*9007199254740992::DOUBLE)::BIGINT)"
    )
    sized = lambda t: f"concat(length({t}), ':', {t})"
    if kind == "float":
        out = number(column)
    elif kind == "floats":
        out = f"array_to_string(list_transform({column}, lambda x: CASE WHEN x IS NULL THEN '~' ELSE {sized(number('x'))} END), ',')"
    elif kind == "time":
        out = f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
    else:
        out = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '~' ELSE {sized(out)} END"


def _sql_digests(name: str, where: str = "true") -> str:
    """Rows of (partition, digest) of a table."""
    columns, by = _SCHEMAS[name]
    texts = ", ".join(_sql_text(c, k or "plain") for c, _, k in (x.partition(":") for x in columns.split()))
    part = f"coalesce(CAST({by} AS VARCHAR), '~')" if by else "''"
    return f"SELECT {part} AS \"partition\", ('0x' || substr(md5(concat_ws(';', {texts})), 1, 15))::BIGINT AS d FROM {name} WHERE {where}"


_SQL_FIGURES = "count(*) AS rows, CAST(coalesce(sum(d::HUGEINT),0) AS VARCHAR) AS digest_sum, coalesce(bit_xor(d),0) AS digest_xor"


def _partitions(spark, sf_dir) -> DataFrame:
    parts = None
    for name, (_, by) in _SCHEMAS.items():
        own = digests.partition_manifest(name, table(spark, sf_dir, name), *([by] if by else []))
        parts = own if parts is None else parts.unionByName(own)
    return parts


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", 'same' AS outcome, {_SQL_FIGURES} FROM ({_sql_digests(t)})" for t in _SCHEMAS)
       + f" UNION ALL SELECT concat('runs:', status), 'unexpected', count(*), '0', 0 FROM (WITH {_RUNS.strip()} SELECT * FROM rl) GROUP BY status")
def manifest(spark, sf_dir):
    """Manifest of every table and the runs, checked against the sums of the tables' partitions."""
    whole = digests.manifest({t: table(spark, sf_dir, t) for t in _SCHEMAS}, _ledger(spark, sf_dir))
    return digests.verify_manifest(digests.added_up(_partitions(spark, sf_dir)), whole)


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", \"partition\", {_SQL_FIGURES} FROM ({_sql_digests(t)}) GROUP BY \"partition\"" for t in _SCHEMAS if t not in ("orders", "lineitem"))
       + f" UNION ALL SELECT 'orders', \"partition\", {_SQL_FIGURES} FROM ("
       + _sql_digests("orders", "o_orderpriority LIKE '1%' OR o_orderkey % 7 <> 0") + ") GROUP BY \"partition\""
       + f" UNION ALL SELECT 'lineitem', \"partition\", {_SQL_FIGURES} FROM ("
       + _sql_digests("lineitem", "l_returnflag <> 'R'") + ") GROUP BY \"partition\"")
def manifest_refresh(spark, sf_dir):
    """After one partition of orders was completed and one of lineitem dropped, only these are read again."""
    known = stage(_partitions(spark, sf_dir).where(F.col("table") != "orders").unionByName(
        digests.partition_manifest("orders", table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 7 != 0), "o_orderpriority")
    ))
    urgent = F.col("o_orderpriority").startswith("1")
    changed = digests.partition_manifest("orders", table(spark, sf_dir, "orders").where(urgent), "o_orderpriority")
    gone = known.where(((F.col("table") == "orders") & F.col("partition").startswith("1")) | ((F.col("table") == "lineitem") & (F.col("partition") == "R")))
    return digests.refreshed(known, changed, gone)


# Stored tables --------------------------------------------------------------------


_PLACES = """
, vs AS (SELECT category, election_date, place, max(electors) AS e, max(voters) AS v FROM f WHERE place IS NOT NULL GROUP BY ALL),
vr AS (SELECT category, election_date, place, subject_key, sum(votes)::BIGINT AS votes FROM f WHERE place IS NOT NULL GROUP BY ALL)
"""


@query(sql_facts() + _PLACES + """
SELECT vs.category, CAST(vs.election_date AS VARCHAR) AS election_date, vs.place AS municipality_key,
       CASE WHEN length(vs.place)%2=0 THEN 'exact_match' ELSE 'mismatch' END AS status, CAST(length(vs.place)%2=0 AS VARCHAR) AS complete_set,
       CASE WHEN length(vs.place)%2=0 THEN e+1 ELSE e END AS official_electors, coalesce(r.n,0) AS results, r.votes,
       CASE WHEN length(vs.place)%2=0 THEN 'verified' ELSE 'partial' END AS queue_status, CASE WHEN length(vs.place)%2=0 THEN 2 ELSE 1 END AS attempts,
       concat('https://x/', vs.place, CASE WHEN length(vs.place)%2=0 THEN '/2' ELSE '/1' END) AS source_urls, 3 AS versions
FROM vs LEFT JOIN (SELECT category, election_date, place, count(*) AS n, sum(votes)::BIGINT AS votes FROM vr
                   WHERE length(place)%2=1 OR votes%3=0 GROUP BY ALL) r
  ON r.category=vs.category AND r.election_date=vs.election_date AND r.place=vs.place""")
def verification_store(spark, sf_dir):
    """Queue, verifications and their rows after two rounds, the second over part of the places, read from one version."""
    rows = stored_facts(spark, sf_dir).where(F.col("place").isNotNull())
    root, key = _folder(spark, "store"), ["category", "election_date", "municipality_key"]
    named = rows.withColumn("municipality_key", F.col("place"))
    places = stage(named.groupBy(*key).agg(F.max("electors").alias("official_electors"), F.max("voters").alias("official_voters")))
    subjects = stage(named.groupBy(*key, "subject_key").agg(F.sum("votes").alias("votes")))
    store.store_queue(spark, root, places.select(*key, F.lit(-1).cast("bigint").alias("round"), F.lit("pending").alias("status"), F.lit(0).alias("attempts")))

    def verified(df: DataFrame, round_: int, good: bool) -> DataFrame:
        urls = F.array(F.concat(F.lit("https://x/"), "municipality_key", F.lit(f"/{round_}")))
        return df.withColumns({
            "verified_at": F.make_timestamp(F.lit(2020 + round_), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
            "status": F.lit("exact_match" if good else "mismatch"), "complete_set": F.lit(good), "source_urls": urls,
        })

    store.store_verifications(spark, root, verified(places, 1, False), subjects)
    even = F.length("municipality_key") % 2 == 0
    again = places.where(even).withColumn("official_electors", F.col("official_electors") + 1)
    store.store_verifications(spark, root, verified(again, 2, True), subjects.where(even & (F.col("votes") % 3 == 0)))

    held = store.read(spark, root, "verifications", store.VERIFICATIONS)
    results = store.read(spark, root, "results", store.RESULTS).groupBy(*key).agg(F.count(F.lit(1)).alias("results"), F.sum("votes").alias("votes"))
    items = store.read(spark, root, "queue", store.QUEUE).select(*key, F.col("status").alias("queue_status"), "attempts", "source_urls")
    joined = held.drop("source_urls").join(results, key, "left").join(items, key).withColumn("results", F.coalesce("results", F.lit(0)))
    return plain(joined.withColumn("versions", F.lit(store.version(spark, root))).select(
        *key, "status", "complete_set", "official_electors", "results", "votes", "queue_status", "attempts", "source_urls", "versions"
    ))


@query("WITH " + _RUNS.strip() + """
SELECT category, CAST(election_date AS VARCHAR) AS election_date, arg_max(status, event_id) AS status,
       arg_max(concat('event ', event_id), event_id) AS result, CASE WHEN arg_max(status, event_id)='failed' THEN arg_max(concat('value ', event_id % 5), event_id) END AS last_error
FROM re GROUP BY category, election_date""")
def run_results(spark, sf_dir):
    """Result and last error of every run, as its last event left them."""
    kind, user = F.col("event_id") % 7, F.col("user_id")
    events = table(spark, sf_dir, "events").select(
        F.when(user % 3 == 0, "camera").when(user % 3 == 1, "senato").otherwise("europee").alias("category"),
        F.make_date((F.lit(1995) + user % 7).cast("int"), F.lit(1), F.lit(1)).alias("election_date"),
        F.when(kind == 0, "running").when(kind == 1, "complete").when(kind == 3, "failed").when(kind == 4, "unavailable").otherwise("partial").alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("sequence"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("result"),
        F.when(kind == 3, F.concat(F.lit("value "), (F.col("event_id") % 5).cast("string"))).alias("last_error"),
    )
    noon = F.col("sequence") < 500
    empty = events.where(F.lit(False)).select(
        "category", "election_date", "status", F.col("at").alias("started_at"), F.col("at").alias("completed_at"), "result", "last_error"
    )
    done = queue.ledger_merge(queue.ledger_merge(empty, events.where(noon)), events.where(~noon))
    return plain(done.select("category", "election_date", "status", "result", "last_error"))


@query(sql_facts() + _TREE + """
SELECT ch.url AS child_url, ch.parent_url, CASE WHEN missing THEN 'parent_missing'
       WHEN subjects_mismatched>0 OR coalesce(parent_electors<>child_electors,false) OR parent_voters<>child_voters
            OR parent_valid_votes<>child_valid_votes THEN 'mismatch'
       WHEN parent_electors IS NULL OR child_electors IS NULL THEN 'incomplete' ELSE 'closed' END AS status
FROM cs JOIN ch USING (parent_url)""")
def closures_of_children(spark, sf_dir):
    """The closure above every child page, through the stored index of children."""
    pages, edges = _tree(stored_facts(spark, sf_dir))
    found = closure.parent_closures(pages, edges)[0]
    named = found.withColumns({"category": F.split("parent_url", "/")[0], "election_date": F.split("parent_url", "/")[1].cast("date")})
    root = _folder(spark, "closures")
    index = closure.child_index(edges, named)
    elections = named.select("category", "election_date").distinct()
    store.commit(spark, root, {"closures": named, "children": index}, elections)
    held = store.read(spark, root, "closures", named.schema)
    children = store.read(spark, root, "children", index.schema)
    asked = edges.select(F.col("child_url").alias("url"))
    return closure.closures_of_children(held.drop("category", "election_date"), children, asked).select("child_url", "parent_url", "status")


@query(sql_facts() + _TREE + """
SELECT row_number() OVER (ORDER BY parent_url) AS position, parent_url, child_pages FROM cs WHERE missing""")
def closure_list(spark, sf_dir):
    """Closures whose parent page is missing, in the order of the list."""
    found = closure.list_closures(closure.parent_closures(*_tree(stored_facts(spark, sf_dir)))[0], status="parent_missing")
    return plain(reads.numbered(found, ("parent_url",)).select("position", "parent_url", "child_pages"))


@query("""
SELECT user_id AS source_url, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id""")
def snapshots_appended(spark, sf_dir):
    """Pages stored in three rounds; the latest of each address is read back."""
    folder = _folder(spark, "snapshots")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_url"), F.col("ts").alias("retrieved_at"), F.col("event_id").alias("id")
    )
    for part in range(3):
        tables.append_snapshots(rows.where(F.col("id") % 3 == part), folder)
    return upsert.latest_snapshots(spark.read.schema(rows.schema).parquet(f"{folder}/page_snapshots")).select("source_url", "id")


# Files and numbers ----------------------------------------------------------------


@query("""
SELECT p_brand AS map_version, p_type AS geography, p_size AS college, p_name AS municipality,
       CASE WHEN p_partkey%3=0 THEN 'zone' ELSE 'whole' END AS entry_type, CASE WHEN p_partkey%3=0 THEN concat('a "b", ', p_size) END AS entry_text,
       p_partkey AS source_page, p_name AS ocr_text, CAST(p_partkey%1000 AS BIGINT) AS match_permille FROM part""")
def registry_file(spark, sf_dir):
    """A registry written as a file and read back, quotes and commas included."""
    path = _folder(spark, "registry")
    part = table(spark, sf_dir, "part")
    zone = F.col("p_partkey") % 3 == 0
    rows = part.select(
        F.col("p_brand").alias("map_version"), F.col("p_type").alias("geography"), F.col("p_size").alias("college"), F.col("p_name").alias("municipality"),
        F.when(zone, "zone").otherwise("whole").alias("entry_type"), F.when(zone, F.concat(F.lit('a "b", '), F.col("p_size").cast("string"))).alias("entry_text"),
        F.col("p_partkey").alias("source_page"), F.col("p_name").alias("ocr_text"), (F.col("p_partkey") % 1000 / 1000).alias("match_score"),
    )
    rows.write.csv(path, header=True, escape='"')
    read = registry.read_registry(spark, path)
    return plain(read.withColumn("match_permille", F.round(F.col("match_score") * 1000).cast("bigint")).drop("match_score"))


@query("SELECT p_partkey, CAST(round(p_retailprice*100) AS BIGINT) AS cents FROM part")
def printed_decimals(spark, sf_dir):
    """Decimals as archives print them, with thousands dots, decimal commas, signs and blanks."""
    part = table(spark, sf_dir, "part")
    text = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    key = F.col("p_partkey") % 4
    printed = (
        F.when(key == 0, F.concat(text, F.lit(" %"))).when(key == 1, F.concat(F.lit("  "), text, F.lit("%")))
        .when(key == 2, F.format_string("%.2f", "p_retailprice")).otherwise(text)
    )
    return part.select("p_partkey", F.round(parse_italian_float(printed) * 100).cast("bigint").alias("cents"))


@query("""
WITH s AS (SELECT conv_id AS page, turn AS line_num, unnest(string_split(text,' ')) AS text, generate_subscripts(string_split(text,' '),1)-1 AS word_num FROM conversations)
SELECT page, line_num*40 + line_num%7*30 + word_num%5 AS top, (page*31+line_num*7+word_num)%40 AS number, line_num, word_num
FROM s WHERE trim(text) <> '' AND word_num % 3 = 0 AND (page + line_num) % 101 > 20""")
def ocr_column_numbers(spark, sf_dir):
    """Numbers of the number column: every third word is one, read with varying confidence."""
    mixed = _words(spark, sf_dir).withColumns({
        "conf": ((F.col("page") + F.col("line_num")) % 101).cast("double"),
        "text": F.when(F.col("word_num") % 3 == 0, ((F.col("page") * 31 + F.col("line_num") * 7 + F.col("word_num")) % 40).cast("string")).otherwise(F.concat(F.lit("a"), "text")),
    })
    return plain(colleges.column_numbers(mixed).select("page", "top", "number", "position.line_num", "position.word_num"))
