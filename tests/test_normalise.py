import datetime as dt

from pyspark.sql import functions as F

from urna.functions.numbers import as_int
from urna.operators.cells import read_int
from urna.operators.normalise import normalise, read_columns

SCHEMA = (
    "archive string, category string, election_date date, member_index int, file_name string, row_number bigint, "
    "region string, constituency string, province string, municipality string, municipality_key string, "
    "payload map<string,string>, numbers map<string,double>"
)


def rows(spark, category, payloads, **over):
    base = dict(file="results.csv", region="LAZIO", province="ROMA", municipality="ROMA", numbers={})
    data = []
    for i, (payload, extra) in enumerate(payloads):
        b = base | over | extra
        data.append((category, category, dt.date(1994, 3, 27), 0, b["file"], 2 + i, b["region"], None, b["province"],
                     b["municipality"], None, payload, b["numbers"]))
    return spark.createDataFrame(data, SCHEMA)


def results(spark, category, *payloads, **over):
    return [r.asDict() for r in normalise(rows(spark, category, [p if isinstance(p, tuple) else (p, {}) for p in payloads], **over))
            .orderBy("source_row", "result_type", "subject").collect()]


def test_summary_rows_join_list_rows_and_sections_are_left_out(spark):
    found = results(
        spark, "comunali",
        ({"turno": "1", "elettoritot": "1000", "votantitot": "600", "skbianche": "10"}, {"file": "scrutini.csv"}),
        {"turno": "1", "lista": "LISTA A", "voti_lista": "450", "cognome": "ROSSI", "nome": "ANNA"},
        {"turno": "1", "lista": "LISTA A", "voti_lista": "120", "sezione": "1"},
    )
    assert len(found) == 1
    row = found[0]
    assert (row["votes"], row["candidate"], row["electors"], row["voters"]) == (450, "ROSSI ANNA", 1000, 600)
    assert (row["turnout_percentage"], row["blank_ballots"], row["subject_key"]) == (60.0, 10, "lista_a")


def test_referendum_options(spark):
    found = results(spark, "referendum", {"num_referendum": "2", "voti_si": "45", "voti_no": "30"})
    assert [(r["option"], r["votes"], r["valid_votes"], r["question_number"]) for r in found] == [("NO", 30, 75, "2"), ("SI", 45, 75, "2")]
    derived = results(spark, "referendum", {"votivalidi": "75", "voti_si": "45"})
    assert [(r["option"], r["votes"], r["question_number"]) for r in derived] == [("NO", 30, "1"), ("SI", 45, "1")]


def test_italian_numbers_and_aliases(spark):
    row = results(spark, "europee", {
        "desclista": "X", "numvoti": "1.234,00", "elettori": "2.000,00", "votanti": "1.500,00",
        "collegiouninominale": "01 - ROMA", "collegioplurinominale": "P", "numschedebianche": "5", "numschedecontestat": "2"})[0]
    assert (row["votes"], row["electors"], row["voters"], row["college"]) == (1234, 2000, 1500, "01 - ROMA")
    assert (row["blank_ballots"], row["contested_ballots"]) == (5, 2)


def test_spreadsheet_numbers_keep_their_type(spark):
    row = results(spark, "europee", ({"lista": "X", "voti_lista": "90.0", "elettori": "1234.5"},
                                     {"numbers": {"voti_lista": 90.0, "elettori": 1234.5}}))[0]
    assert (row["votes"], row["electors"]) == (90, None)


def test_sections_are_summed_only_without_aggregate_rows(spark):
    def section(n, name, votes, electors, voters, blank):
        return {"sezione": n, "lista": name, "voti_lista": votes, "elettori": electors, "votanti": voters, "schede_bianche": blank}

    found = results(
        spark, "camera",
        section("1", "A", "40", "100", "70", "1"), section("1", "B", "30", "100", "70", "1"),
        section("2", "A", "50", "120", "80", "2"), section("2", "B", "10", "120", "80", "2"),
    )
    assert [(r["subject"], r["votes"], r["electors"], r["voters"], r["blank_ballots"], r["source_row"]) for r in found] == [
        ("A", 90, 220, 150, 3, 0), ("B", 40, 220, 150, 3, 0)]
    assert found[0]["valid_list_votes"] == 130 and found[0]["percentage"] == 69.230769
    assert found[0]["source_file"] == "results.csv#municipality-aggregate"


def test_region_comes_from_the_constituency_prefix(spark):
    row = results(spark, "senato", {"circ_reg": "Lombardia 2", "lista": "X", "voti_lista": "1"}, region=None)[0]
    assert (row["region"], row["constituency"]) == ("LOMBARDIA", "Lombardia 2")


def test_only_contexts_that_differ_are_filled(spark, monkeypatch):
    """Contexts with equal figures, with differing ones, and with null keys; the result is the same however crowded the filter."""
    from urna.operators import normalise as own

    payloads = []
    for n in range(40):
        place = {"municipality": f"C{n % 13}", "province": None if n % 5 == 0 else f"P{n % 3}"}
        figures = {"elettoritot": "1000"} if n % 13 < 6 else {"elettoritot": str(1000 + n)} if n % 2 else {}
        payloads.append(({"turno": "1", "lista": f"L{n}", "voti_lista": str(n), "votantitot": "600", **figures}, place))

    def expected():
        first = {}
        for p, place in payloads:
            key = (place["municipality"], place["province"])
            if "elettoritot" in p:
                first.setdefault(key, int(p["elettoritot"]))
        return sorted((p["lista"], first.get((place["municipality"], place["province"]))) for p, place in payloads)

    for bits in (1 << 23, 1 << 15):
        monkeypatch.setattr(own, "_FILTER_BITS", bits)
        assert sorted((r["subject"], r["electors"]) for r in results(spark, "comunali", *payloads)) == expected()


def test_cells_are_read_as_the_expressions_read_them(spark):
    texts = ["", "12", "1.234,00", "1.234,5", "-5", "+5", ",00", "-,0", ",", "1\u00a02", " 3\u2003", "\x1c4", "\x004", "a1", "٣", "00012",
             "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "1" * 30, "0" * 30 + "7", "1,0,0"]
    rows_ = spark.createDataFrame([(t,) for t in texts], "t string").select("t", as_int(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows_} == {t: read_int(t) for t in texts}


def test_numbers_fall_through_to_the_next_alias_and_a_payload_may_be_missing(spark):
    found = read_columns(rows(spark, "camera", [
        ({"elettori": "x", "elettoritot": "7", "lista": "", "descrlista": "Y"}, {}),
        (None, {}),
        ({"elettori": "5"}, {"numbers": {"elettori": 1.5, "voti_lista": 3.0}}),
        ({"elettori": "5"}, {"numbers": {"elettori": 2.0**63}, "file": "Preferenze (1).csv"}),
    ])).orderBy("row_number").collect()
    assert [(r.electors, r.party, r.party_votes) for r in found] == [(7, "Y", None), (None, None, None), (None, None, None), (2**63 - 1, None, None)]
    assert [(r.not_aggregate, r.not_results) for r in found] == [(False, False)] * 3 + [(True, True)]


def test_the_names_of_a_row_are_not_searched_once_an_alias(spark):
    plan = read_columns(rows(spark, "camera", [({"lista": "A"}, {})]))._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" in plan and "element_at(payload" not in plan
