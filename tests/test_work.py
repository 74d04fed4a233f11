import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.operators import colleges, facts as reads, queue, upsert
from urna.sinks import exports, manifest, tables
from urna.streaming.ingest import ingest_archives

DAY = dt.date(1994, 3, 27)
FACT = "category string, election_date date, region string, province string, constituency string, municipality string, round bigint, voters bigint, college string"


def test_queue_joins_fragments_and_follows_verifications(spark):
    facts = spark.createDataFrame(
        [("camera", DAY, None, "ROMA", None, "ROMA I", 1, 90, "1"), ("camera", DAY, None, "ROMA", None, "ROMA II", 1, 40, "2"),
         ("camera", DAY, None, "RIETI", None, "RIETI", None, 25000, "9")], FACT)
    candidates = queue.queue_candidates(facts)
    merged = queue.merge_queue(candidates, queue.empty_queue(candidates))
    items = {r["municipality_key"]: r for r in merged.collect()}
    assert set(items) == {"p:roma|roma", "p:rieti|rieti"}
    assert (items["p:roma|roma"]["priority"], items["p:rieti|rieti"]["priority"], items["p:rieti|rieti"]["round"]) == (1000, 2, -1)
    stored = spark.createDataFrame(
        [("camera", DAY, "p:roma|roma", True, dt.datetime(2026, 1, 1)), ("camera", DAY, "rieti", False, dt.datetime(2026, 1, 1))],
        "category string, election_date date, verification_key string, complete_set boolean, verified_at timestamp")
    found = {r["municipality_key"]: r["status"] for r in queue.apply_verifications(merged, stored).collect()}
    assert found == {"p:roma|roma": "verified", "p:rieti|rieti": "partial"}
    listed = queue.list_queue(queue.apply_verifications(merged, stored)).collect()
    assert [r["municipality"] for r in listed] == ["ROMA", "RIETI"] and listed[1]["round"] is None
    again = queue.merge_queue(candidates.withColumn("priority", F.lit(1).cast("bigint")), merged.withColumn("status", F.lit("failed")))
    assert {(r["priority"], r["status"]) for r in again.collect()} == {(1000, "failed"), (2, "failed")}


def test_ledger_and_pending_elections(spark):
    schema = "category string, election_date date, status string, at timestamp, sequence bigint"
    at = [dt.datetime(2026, 1, d) for d in range(1, 9)]
    events = spark.createDataFrame([("camera", DAY, "running", at[0], 1), ("camera", DAY, "partial", at[1], 2),
                                    ("senato", DAY, "complete", at[2], 3)], schema)
    empty = events.where("false").select("category", "election_date", "status", F.col("at").alias("started_at"), F.col("at").alias("completed_at"))
    ledger = queue.ledger_merge(empty, events)
    later = spark.createDataFrame([("camera", DAY, "failed", at[4], 4)], schema)
    rows = {r["category"]: r for r in queue.ledger_merge(ledger, later).collect()}
    assert (rows["camera"]["status"], rows["camera"]["started_at"], rows["camera"]["completed_at"]) == ("failed", at[0], at[4])
    assert (rows["senato"]["started_at"], rows["senato"]["completed_at"]) == (at[2], at[2])
    imported = spark.createDataFrame([("camera", DAY), ("senato", DAY), ("europee", DAY)], "category string, election_date date")
    assert [r["category"] for r in queue.pending_elections(imported, ledger).collect()] == ["camera", "europee"]
    assert queue.pending_elections(imported, ledger, retry_complete=True).count() == 3


def test_upsert_rewrites_only_touched_elections(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "category string, election_date date, k string, v int"
    tables.upsert(spark, spark.createDataFrame([("camera", DAY, "a", 1), ("camera", DAY, "b", 1), ("senato", DAY, "a", 1)], schema), path, ["category", "election_date", "k"], ["v"])
    tables.upsert(spark, spark.createDataFrame([("camera", DAY, "a", 0), ("camera", DAY, "c", 2)], schema), path, ["category", "election_date", "k"], ["v"])
    rows = spark.read.parquet(path).select("category", "k", "v").collect()
    assert sorted(map(tuple, rows)) == [("camera", "a", 0), ("camera", "b", 1), ("camera", "c", 2), ("senato", "a", 1)]


def test_latest_snapshot_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([("u", 1, 1, "x"), ("u", 1, 2, "y"), ("v", 3, 3, "z")], "source_url string, retrieved_at int, id int, payload string")
    assert sorted((r["source_url"], r["payload"]) for r in upsert.latest_snapshots(rows).collect()) == [("u", "y"), ("v", "z")]


def test_csv_export_has_bom_header_and_order(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, "RO;MA", "B", 2), (DAY, "ROMA", 'A "x"', 1)], "data date, comune string, partito string, voti int")
    path = tmp_path / "csv"
    exports.write_csv(rows.coalesce(1), str(path), fv.MUNICIPAL_COMPACT_COLUMNS, ("voti",))
    text = "".join(p.read_text("utf-8") for p in sorted(path.glob("part-*")))
    assert text.startswith("﻿DATA;COMUNE;PARTITO;VOTI\n")
    assert text.splitlines()[1:] == ['1994-03-27;ROMA;"A ""x""";1', '1994-03-27;"RO;MA";B;2']
    lines = [r["line"] for r in exports.export_lines(rows, fv.MUNICIPAL_COMPACT_COLUMNS).collect()]
    assert sorted(lines) == sorted(text.splitlines()[1:])


def test_manifest_sees_a_changed_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    written = manifest.manifest({"a": a, "gone": a})
    found = manifest.manifest({"a": a.orderBy(F.desc("i")), "new": a})
    assert {r["table"]: r["outcome"] for r in manifest.verify_manifest(written, found).collect()} == {"a": "same", "gone": "missing", "new": "unexpected"}
    changed = manifest.manifest({"a": a.withColumn("t", F.lit("y"))})
    assert manifest.verify_manifest(written.where("table = 'a'"), changed).first()["outcome"] == "different"


def test_keyset_pages_continue_each_other(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(40)], "i int, k int")
    order = ("k", "i")
    everything = [tuple(r) for r in reads.page(rows, order, limit=40).select(*order).collect()]
    first = reads.page(rows, order, limit=15).collect()
    rest = reads.page_after(rows, order, first[-1].asDict(), limit=40).select(*order).collect()
    assert [tuple(r) for r in rest] == everything[15:]


def test_stream_picks_up_new_archives_once(spark, tmp_path):
    def put(name, votes):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            z.writestr("r.csv", f"comune;lista;voti_lista\nROMA;A;{votes}\n")

    (tmp_path / "in").mkdir()
    catalogue = spark.createDataFrame([("a.zip", "camera", DAY), ("b.zip", "senato", DAY)], "filename string, category string, election_date date")

    def run():
        ingest_archives(spark, str(tmp_path / "in"), catalogue, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        return sorted((r["category"], r["votes"]) for r in spark.read.parquet(str(tmp_path / "out" / "election_results")).collect())

    put("a.zip", 5)
    assert run() == [("camera", 5)]
    put("b.zip", 7)
    assert run() == [("camera", 5), ("senato", 7)]


def test_scanned_names_prefer_edits_and_refuse_ties(spark):
    names = spark.createDataFrame([("g", n) for n in ("DUNO", "MADONE", "BARIANO", "BARZANO'")], "geography string, name string")
    scanned = spark.createDataFrame([("g", t) for t in ("DUNE", "BARANO", "MADONE", "ZZZZ")], "geography string, text string")
    found = {r["text"]: (r["municipality"], r["score"]) for r in colleges.accepted_names(colleges.match_names(scanned, names)).collect()}
    assert found["DUNE"] == ("DUNO", 0.75) and found["MADONE"] == ("MADONE", 1.0)
    assert found["BARANO"][0] is None and found["ZZZZ"] == (None, None)


def test_names_are_found_by_pieces_as_by_comparing_all(spark, monkeypatch):
    import itertools

    official = ["".join(x) for x in itertools.product(("MONTE", "CASTEL", "SAN "), ("ROSSO", "VERDE", "NOVO"), ("", " ALTO"))]
    scanned = [n[:k] + n[k + 1 :] for n in official for k in (1, 4, 7)] + [n[:3] + "X" + n[3:] for n in official]
    names = spark.createDataFrame([("g", n) for n in official], "geography string, name string")
    asked = spark.createDataFrame([("g", t) for t in scanned], "geography string, text string")
    found = []
    for direct in (256, 0):
        monkeypatch.setattr(colleges, "DIRECT", direct)
        found.append(sorted((r["text"], r["municipality"], round(r["score"] or 0, 9)) for r in colleges.match_names(asked, names).collect()))
    assert found[0] == found[1] and any(m for _, m, _ in found[0])


def test_decree_entries(spark):
    lines = ["( RM-MONTI )", "C RM-PRENESTINO-LABICANO", "{ FI EX-QUART.1 })", "{ PARMA-CIRC.1 )", "PONT-CANAVESE", "SAINT-MARCEL", "BORGARO TORINESE"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "college int, line_no int, line string")
    found = [(r["kind"], r["code"], r["prefix"]) for r in colleges.line_entries(df, "college").orderBy("line_no").collect()]
    assert found == [("zone", "RM", None), ("zone", "RM", None), ("zone", "FI", None), ("zone", None, "PARMA"),
                     ("zone", None, "PONT"), ("zone", None, "SAINT"), ("whole", None, None)]
    prose = ["Comprende i seguenti comuni: Baronissi, Bracigliano,", "Calvanico, Pellezzano e San Mango Piemonte nonchè parte del",
             "territorio del comune di Salerno, delimitata come segue: confine"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(prose)], "college int, line_no int, line string")
    found = sorted((r["kind"], r["name"]) for r in colleges.prose_entries(df, "college").collect())
    assert found == [("described_part", "SALERNO"), ("whole", "BARONISSI"), ("whole", "BRACIGLIANO"), ("whole", "CALVANICO"),
                     ("whole", "PELLEZZANO"), ("whole", "SAN MANGO PIEMONTE")]
    assert colleges.line_entries(df, "college").count() == 0


def test_zone_cities(spark):
    entries = spark.createDataFrame(
        [("LAZIO 1", 1, 1, "zone", None, "RM"), ("LAZIO 1", 1, 2, "zone", None, None), ("LAZIO 1", 2, 1, "zone", None, None),
         ("LAZIO 1", 2, 2, "zone", "PONT", None), ("EMILIA", 1, 1, "zone", "PARMA", None), ("EMILIA", 1, 2, "whole", None, None)],
        "geography string, college int, position int, kind string, prefix string, code string")
    splits = spark.createDataFrame([("LAZIO 1", "ROMA")], "geography string, name string")
    names = spark.createDataFrame([("LAZIO 1", "ROMA"), ("EMILIA", "PARMA")], "geography string, name string")
    found = [(r["kind"], r["city"]) for r in colleges.zone_cities(entries, splits, names).orderBy("geography", "college", "position").collect()]
    assert found == [("zone", "PARMA"), ("whole", None), ("zone", "ROMA"), ("zone", "ROMA"), ("zone", "ROMA"), ("whole", None)]
