import datetime as dt

import pytest
from pyspark.sql import functions as F

from urna import reference_data
from urna.operators import audit, closure, layers, maps, verify

FACT = (
    "archive string, category string, election_date date, source_file string, result_type string, round bigint, "
    "region string, province string, constituency string, municipality string, college string, subject string, "
    "subject_key string, votes bigint, electors bigint, voters bigint"
)


def facts(spark, *rows):
    data = []
    for category, day, label, college, subject, votes, electors, voters, *scope in rows:
        region, province, constituency = scope or ("LAZIO", "ROMA", None)
        data.append((f"{category}-{day}", category, dt.date.fromisoformat(day), "r.csv", "list", None, region, province,
                     constituency, label, college, subject, subject.lower().replace(" ", "_"), votes, electors, voters))
    return spark.createDataFrame(data, FACT)


def audited(spark, *rows, **options):
    units = layers.fragment_units(layers.with_keys(facts(spark, *rows)))
    best = layers.best_layer(layers.layers(units))
    return [r.asDict() for r in audit.temporal_audit(audit.no_overlay(best), **options).orderBy("election_date", "category").collect()]


def test_fragments_are_rebuilt_and_compared(spark):
    rows = audited(
        spark, ("camera", "1992-04-05", "ROMA", "", "A", 500, 1000, 800),
        ("camera", "1994-03-27", "Roma centro", "1", "A", 250, 500, 400),
        ("camera", "1994-03-27", "Roma - Appio", "2", "A", 250, 500, 400),
    )
    last = rows[1]
    assert (last["parts"], last["electors"], last["votes"], last["stato"]) == (2, 1000, 500, "pass")
    assert (str(last["data_riferimento"]), last["rapporto_aventi_diritto_riferimento"]) == ("1992-04-05", 1.0)
    assert last["mappa_collegi_versione"] == "camera-mattarellum-1993-corrected"


def test_nearest_reference_and_tolerance(spark):
    near = audited(spark, ("camera", "1987-06-14", "ROMA", "", "A", 500, 800, 700), ("camera", "1994-03-27", "ROMA", "", "A", 500, 1000, 700),
                   ("camera", "1996-04-21", "ROMA", "", "A", 500, 1020, 700))
    assert (str(near[2]["data_riferimento"]), near[2]["rapporto_aventi_diritto_riferimento"]) == ("1994-03-27", 1.02)
    series = [("camera", d, "ROMA", "", "A", 350, 1000, v) for d, v in (("1992-04-05", 800), ("1994-03-27", 400), ("1996-04-21", 820))]
    middle = audited(spark, *series)[1]
    assert (middle["rapporto_votanti_precedenti"], middle["rapporto_votanti_successivi"], middle["stato"]) == (0.5, 0.487805, "warning")
    assert audited(spark, *series, voter_tolerance=0.55)[1]["stato"] == "pass"
    with pytest.raises(ValueError):
        audited(spark, *series, voter_tolerance=1)


def test_same_date_chamber_replaces_neighbours(spark):
    rows = audited(spark, ("camera", "1992-04-05", "ROMA", "", "A", 300, 500, 100), ("camera", "1994-03-27", "ROMA", "", "A", 300, 500, 400),
                   ("senato", "1994-03-27", "ROMA", "", "A", 300, 500, 420), voter_tolerance=0.10)
    camera, senato = rows[1], rows[2]
    assert (camera["rapporto_votanti_stessa_data"], senato["rapporto_votanti_stessa_data"]) == (0.952381, 1.05)
    assert (camera["stato"], senato["stato"], camera["data_precedente"]) == ("pass", "pass", None)


def test_votes_without_voters_are_invalid_and_unknown_units_make_layers_unknown(spark):
    rows = audited(spark, ("camera", "1994-03-27", "ROMA", "1", "A", 10, 500, 0), ("camera", "1996-04-21", "ROMA", "1", "A", 10, None, 10),
                   ("camera", "1996-04-21", "Roma II", "2", "A", 10, 100, 10))
    assert (rows[0]["stato"], rows[1]["electors"], rows[1]["stato"]) == ("invalid", None, "insufficient_data")


PAGE = (
    "url string, category string, election_date date, municipality string, province string, region string, constituency string, "
    "electors bigint, voters bigint, college_code string, label string, records array<struct<position:int,record_type:string,"
    "name:string,round:bigint,votes:bigint,percentage:double,seats:bigint>>"
)


def pages(spark, *rows):
    data = []
    for url, label, code, electors, voters, votes, *scope in rows:
        province, region, constituency = scope or ("ROMA", "LAZIO", None)
        records = [(i, "list", n, None, v, None, None) for i, (n, v) in enumerate(votes)]
        records.append((99, "total", "TOTALI", None, sum(v for _, v in votes), None, None))
        data.append((url, "camera", dt.date(1996, 4, 21), label, province, region, constituency, electors, voters, code, url, records))
    return spark.createDataFrame(data, PAGE)


def verified(spark, rows, page_rows, tolerance=0.0):
    sets = verify.page_sets(pages(spark, *page_rows))
    summaries, totals = verify.set_summaries(sets), verify.official_totals(sets)
    chosen, local = verify.local_layers(rows, summaries)
    fields = verify.compare_fields(summaries, verify.official_valid_votes(sets, totals), chosen, tolerance=tolerance)
    subjects = verify.compare_subjects(totals, chosen, local, tolerance=tolerance)
    return sets, verify.verification_status(summaries, chosen, fields, subjects), fields


ROME = (
    ("camera", "1996-04-21", "ROMA I", "ROMA I", "A", 100, 500, 450), ("camera", "1996-04-21", "ROMA I", "ROMA I", "B", 200, 500, 450),
    ("camera", "1996-04-21", "ROMA II", "ROMA II", "A", 150, 600, 500), ("camera", "1996-04-21", "ROMA II", "ROMA II", "B", 250, 600, 500),
)


def test_page_sets_match_the_reconstruction(spark):
    rows = facts(spark, *ROME)
    _, status, fields = verified(spark, rows, [("u", "ROMA", "1", 1100, 950, (("A", 250), ("B", 450)))])
    found = status.first()
    assert (found["stato"], found["partiti_confrontati"], found["pezzi_open_data"]) == ("exact_match", 2, 2)
    assert {r["campo"]: (r["ufficiale"], r["scarto"]) for r in fields.collect()} == {
        "aventi_diritto": (1100, 0), "votanti": (950, 0), "voti_validi": (700, 0)}
    two = [("u1", "Roma centro", "1", 500, 450, (("A", 100), ("B", 200))), ("u2", "Roma II", "2", 600, 500, (("A", 150), ("B", 251)))]
    assert verified(spark, rows, two)[1].first()["stato"] == "mismatch"
    assert verified(spark, rows, two, tolerance=0.01)[1].first()["stato"] == "within_tolerance"
    elsewhere = verified(spark, rows, [("u", "CIAMPINO", "1", 1, 1, (("A", 1),))])[1].first()
    assert elsewhere["stato"] == "local_data_missing"


def test_mixed_page_sets_are_rejected(spark):
    both = pages(spark, ("a", "BRIONE", "1", 1, 1, (("A", 1),), "BRESCIA", None, None), ("b", "BRIONE", "1", 1, 1, (("A", 1),), "TRENTO", None, None),
                 ("c", "X", "1", 1, 1, (("A", 1),), None, None, None)).withColumn("set_id", F.when(F.col("url") == "c", "n").otherwise("m"))
    assert {r["set_id"]: r["reason"] for r in verify.page_set_rejects(both).collect()} == {"m": "different_province", "n": "geography_missing"}


def test_completeness_reasons(spark):
    sets = verify.page_sets(pages(spark, *[(f"u{c}", "ROMA", c, 1, 1, (("A", 1),), None, None, "LAZIO 1") for c in ("1", "2", "12")]))
    registry = spark.createDataFrame([("camera-mattarellum-1993-corrected", "LAZIO 1", c, "ROMA") for c in range(1, 25)] +
                                     [("camera-mattarellum-1993-corrected", "LAZIO 1", 3, "CASTRO")],
                                     "map_version string, geography string, college int, municipality string")
    legal = verify.legal_piece_count(sets, registry)
    assert (legal.first()["stato"], legal.first()["collegi_pagine"], len(legal.first()["collegi_legali"])) == ("mismatch", [1, 2, 12], 24)
    small = registry.where("municipality = 'ROMA' and college in (1, 2, 12)")
    assert verify.legal_piece_count(sets, small).first()["stato"] == "pass"
    status = sets.select("place", "category", "election_date").distinct().withColumn("stato", F.lit("exact_match"))
    edges = sets.select(F.col("url").alias("child_url"), F.concat("url", F.lit("p")).alias("parent_url"))
    closed = edges.select("parent_url", F.lit("closed").alias("status"))

    def reasons(closures, found):
        return verify.completeness(status, verify.closure_outcome(sets, closures, edges), found).first()["completezza_motivi"]

    assert reasons(closed.limit(0), legal) == ["college_closure_not_available", "legal_piece_count"]
    assert reasons(closed, verify.legal_piece_count(sets, small)) == []
    broken = closed.withColumn("status", F.when(F.col("parent_url") == "u12p", "mismatch").otherwise("closed"))
    assert reasons(broken, verify.legal_piece_count(sets, small)) == ["college_closure_fail"]


def test_legal_lookup_keeps_missing_and_empty_apart(spark):
    registry = spark.createDataFrame([("camera-mattarellum-1993-corrected", "LAZIO 1", c, "ROMA") for c in (12, 1, 2)],
                                     "map_version string, geography string, college int, municipality string")
    asked = spark.createDataFrame([("camera", dt.date(1996, 4, 21), "Roma", "LAZIO 1"), ("camera", dt.date(1996, 4, 21), "CASTRO", "PUGLIA"),
                                   ("camera", dt.date(1958, 5, 25), "ROMA", "LAZIO 1"), ("camera", dt.date(1996, 4, 21), "ROMA", None)],
                                  "category string, election_date date, municipality string, geography string")
    found = {(r["municipality"], r["geography"], r["election_date"].year): r["collegi_legali"] for r in verify.legal_colleges(asked, registry).collect()}
    assert found == {("Roma", "LAZIO 1", 1996): [1, 2, 12], ("CASTRO", "PUGLIA", 1996): [], ("ROMA", "LAZIO 1", 1958): None, ("ROMA", None, 1996): [1, 2, 12]}


def test_closures(spark):
    parent = ("P", None, "12", 104499, 93276, (("AN", 29951), ("PDS", 23067)))
    ciampino = ("c1", "CIAMPINO", "12", 29259, 26364, (("AN", 8000), ("PDS", 7000)))
    rome = ("c2", "parte del comune di Roma", "12", 75240, 66912, (("AN", 21951), ("PDS", 16067)))
    links = [("P", "c1"), ("P", "c2"), ("Q", "c1")]
    df = pages(spark, parent, ciampino, rome)
    edges = spark.createDataFrame(links, "parent_url string, child_url string")
    closures, _ = closure.parent_closures(df, edges)
    found = {r["parent_url"]: r for r in closures.collect()}
    assert (found["P"]["status"], found["P"]["child_electors"], found["P"]["subjects_compared"]) == ("closed", 104499, 2)
    assert found["Q"]["status"] == "parent_missing"
    closures, mismatches = closure.parent_closures(df, edges.where("child_url = 'c1' and parent_url = 'P'"))
    assert closures.first()["status"] == "mismatch"
    assert sorted(r["subject"] for r in mismatches.collect()) == ["list:an", "list:pds"]


def test_maps_and_laws(spark):
    assert (reference_data.laws(spark).count(), reference_data.map_versions(spark).count()) == (27, 13)
    days = [("senato", 1958), ("senato", 1963), ("senato", 1992), ("camera", 1994), ("camera", 2003)]
    df = spark.createDataFrame([(c, dt.date(y, 5, 1)) for c, y in days], "category string, election_date date")
    found = {(r["category"], r["election_date"].year): r["map_id"] for r in maps.with_map_version(df).collect()}
    assert found == {("senato", 1958): "senato-1948-corrected", ("senato", 1963): "senato-1963-friuli", ("senato", 1992): "senato-1992-trentino",
                     ("camera", 1994): "camera-mattarellum-1993-corrected", ("camera", 2003): None}
    cited = maps.map_sources(reference_data.map_versions(spark), reference_data.laws(spark))
    rows = maps.list_maps(cited, year=2018).collect()
    assert len(rows) == 2 and all(len(r["source_citations"]) == 3 for r in rows)
