import datetime as dt
import gzip
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.operators import facts as reads, queue
from urna.sinks import exports, manifest, store
from urna.session import stage

DAY, OTHER = dt.date(1994, 3, 27), dt.date(1996, 4, 21)
AT = [dt.datetime(2026, 1, d) for d in range(1, 9)]
KEY = "category string, election_date date, municipality_key string"


def places(spark, *rows):
    schema = f"{KEY}, verified_at timestamp, status string, complete_set boolean, official_electors bigint, source_urls array<string>"
    return spark.createDataFrame(list(rows), schema)


def subjects(spark, *rows):
    return spark.createDataFrame(list(rows), f"{KEY}, subject string, round bigint, votes bigint")


def held(spark, root, number=None):
    tables = (("verifications", store.VERIFICATIONS), ("results", store.RESULTS), ("queue", store.QUEUE))
    v, r, q = (store.read(spark, root, name, schema, number) for name, schema in tables)
    return (
        sorted((x.municipality_key, x.status, x.official_electors) for x in v.collect()),
        sorted((x.municipality_key, x.subject, x.round, x.votes) for x in r.collect()),
        sorted((x.municipality_key, x.status, x.attempts, x.source_urls, x.last_error) for x in q.collect()),
    )


@pytest.fixture()
def filled(spark, tmp_path):
    root = str(tmp_path / "store")
    items = [("camera", DAY, "roma", "pending", 0, "timeout"), ("camera", DAY, "rieti", "failed", 2, "timeout"), ("senato", DAY, "roma", "pending", 0, None)]
    store.store_queue(spark, root, spark.createDataFrame(items, f"{KEY}, status string, attempts bigint, last_error string"))
    store.store_verifications(
        spark, root,
        places(spark, ("camera", DAY, "roma", AT[0], "mismatch", False, 10, ["a"]), ("camera", DAY, "roma", AT[1], "exact_match", True, 11, ["b"])),
        subjects(spark, ("camera", DAY, "roma", "A", None, 5), ("camera", DAY, "roma", "B", 0, 6), ("camera", DAY, "latina", "Z", 1, 9)),
    )
    return root


FIRST = (
    [("roma", "exact_match", 11)],
    [("roma", "A", -1, 5), ("roma", "B", -1, 6)],
    [("rieti", "failed", 2, None, "timeout"), ("roma", "pending", 0, None, None), ("roma", "verified", 1, ["b"], None)],
)


def test_a_verification_brings_rows_and_queue_mark_with_it(spark, filled):
    assert held(spark, filled) == FIRST and store.version(spark, filled) == 2
    store.store_verifications(
        spark, filled, places(spark, ("camera", DAY, "roma", AT[2], "mismatch", False, 12, ["c"]), ("senato", OTHER, "bari", AT[2], "mismatch", False, 1, None)),
        subjects(spark, ("camera", DAY, "roma", "C", 2, 7)),
    )
    # Old rows of the place are gone, other elections are as they were.
    assert held(spark, filled) == (
        [("bari", "mismatch", 1), ("roma", "mismatch", 12)], [("roma", "C", 2, 7)],
        [("rieti", "failed", 2, None, "timeout"), ("roma", "partial", 2, ["c"], None), ("roma", "pending", 0, None, None)],
    )
    assert held(spark, filled, 2) == FIRST


def test_a_commit_that_fails_between_two_tables_changes_nothing(spark, filled, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    written, plain = [], DataFrame.hint

    def hint(self, name, *args):
        if name == "rebalance":
            written.append(name)
            if len(written) == 2:
                raise RuntimeError("lost")
        return plain(self, name, *args)

    monkeypatch.setattr(DataFrame, "hint", hint)
    new = places(spark, ("camera", DAY, "roma", AT[3], "mismatch", False, 99, ["x"]))
    with pytest.raises(RuntimeError):
        store.store_verifications(spark, filled, new, subjects(spark, ("camera", DAY, "roma", "X", 1, 1)))
    assert len(written) == 2
    monkeypatch.setattr(DataFrame, "hint", plain)
    assert held(spark, filled) == FIRST and store.version(spark, filled) == 2
    store.store_verifications(spark, filled, new, subjects(spark))
    assert held(spark, filled)[0] == [("roma", "mismatch", 99)] and held(spark, filled)[1] == []


def test_old_folders_are_removed_and_versions_are_not_replaced(spark, filled):
    for n in range(3):
        store.store_verifications(spark, filled, places(spark, ("camera", DAY, "roma", AT[3 + n], "mismatch", False, n, [])), subjects(spark))
    before = held(spark, filled)
    assert store.clean(spark, filled, keep=1) > 0 and store.clean(spark, filled, keep=1) == 0
    assert held(spark, filled) == before and store.version(spark, filled) == 5
    with pytest.raises(ValueError):
        held(spark, filled, 2)
    with pytest.raises(ValueError):
        store.commit(spark, filled, {"queue": spark.createDataFrame([("x", DAY)], "category string, election_date date")},
                     spark.createDataFrame([("camera", DAY)], "category string, election_date date"))


def test_an_unfinished_version_is_not_current(spark, filled):
    files, place = store._files(spark, f"{filled}/versions/{3:012d}")
    out = files.create(place, False)
    out.write(bytearray(b"half"))
    out.close()
    assert store.version(spark, filled) == 2 and held(spark, filled) == FIRST


def test_nothing_stored_reads_as_nothing(spark, tmp_path):
    assert held(spark, str(tmp_path / "none")) == ([], [], [])


def test_numbered_pages_continue_each_other(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 7, "x" if i % 5 else None) for i in range(500)], "i int, a int, position string")
    rows = rows.drop("position").repartition(6)
    order = ("a", F.col("i").desc())
    everything = [(r.a, r.i) for r in reads.ordered(rows, order).collect()]
    got = {r.position: (r.a, r.i) for r in reads.numbered(rows, order).collect()}
    assert [got[n + 1] for n in range(500)] == everything
    page = reads.numbered_page(rows, order, limit=20, offset=470).collect()
    assert sorted((r.position, (r.a, r.i)) for r in page) == [(n + 1, everything[n]) for n in range(470, 490)]
    assert reads.numbered(rows.limit(0), order).count() == 0
    with pytest.raises(ValueError):
        reads.numbered_page(rows, order, limit=5001)


def test_digests_of_partitions_add_up(spark):
    rows = [(i, None if i % 3 else "a;b", float("nan") if i == 5 else i / 7, [1.5, None], {"k": "v", "j": None}, dt.datetime(2020, 1, 1, 0, 0, i), i % 4) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, t string, x double, v array<double>, m map<string,string>, ts timestamp, part int")
    parts = manifest.partition_manifest("t", df, "part")
    whole = manifest.table_manifest("t", df.repartition(5))
    assert manifest.verify_manifest(whole, manifest.added_up(parts)).first()["outcome"] == "same"
    changed = df.withColumn("x", F.when(F.col("i") == 6, F.col("x") + 1e-9).otherwise(F.col("x")))
    own = manifest.partition_manifest("t", changed.where("part = 2"), "part")
    renewed = manifest.added_up(manifest.refreshed(parts, own, own))
    assert manifest.verify_manifest(whole, renewed).first()["outcome"] == "different"
    assert manifest.verify_manifest(manifest.table_manifest("t", changed), renewed).first()["outcome"] == "same"
    # Values that run together differently are different rows.
    a, b = (spark.createDataFrame([r], "a string, b string") for r in (("x;1:y", "z"), ("x", "1:y;z")))
    assert manifest.table_manifest("t", a).first()["digest_xor"] != manifest.table_manifest("t", b).first()["digest_xor"]
    ledger = spark.createDataFrame([("complete",), ("failed",), ("complete",)], "status string")
    assert {(r["table"], r["rows"]) for r in manifest.manifest({"t": df}, ledger).collect()} == {("t", 30), ("runs:complete", 2), ("runs:failed", 1)}


def test_export_files_joined_end_to_end_are_one_file(spark, tmp_path):
    rows = spark.createDataFrame(
        [(DAY, None if i % 9 == 0 else f"C{i % 17:02d}", f'P "{i}";', i) for i in range(400)], "data date, comune string, partito string, voti int"
    ).repartition(5)
    # As large as these rows are they would be joined into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = exports.write_export(rows, str(tmp_path / "out"), fv.MUNICIPAL_COMPACT_COLUMNS, ("comune", "voti"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(names) > 2 and (tmp_path / "out" / "ORDER").read_text().split() == names
    joined = b"".join((tmp_path / "out" / n).read_bytes() for n in names).decode("utf-8")
    expected = sorted(((f"C{i % 17:02d}" if i % 9 else ""), i) for i in range(400))
    lines = "".join(f'1994-03-27;{c};"P ""{i}"";";{i}\n' for c, i in expected)
    assert joined == "﻿DATA;COMUNE;PARTITO;VOTI\n" + lines
    read = exports.read_export(spark, str(tmp_path / "out"))
    assert read.count() == 401 and read.where("file = 0").count() == 1
    maps = spark.createDataFrame([({"b": "2", "a": None}, ["x"])], "m map<string,string>, l array<string>")
    assert exports.payload_lines(maps).first()["line"] in ('{"m":{"a":null,"b":"2"},"l":["x"]}', '{"m":{"b":"2"},"l":["x"]}')


def test_packed_export_is_the_same_file_and_sorts_what_it_is_made_of(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, f"C{i % 17:02d}" if i % 9 else None, i) for i in range(400)], "data date, comune string, voti bigint")
    marks = F.concat(F.lit('P "'), "voti", F.lit('";\n'))
    columns, order = fv.MUNICIPAL_COMPACT_COLUMNS, ("comune", "voti")
    shaped = lambda df: df.withColumn("partito", marks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = exports.write_export(shaped(rows), str(tmp_path / "plain"), columns, order)
        packed = exports.write_export(rows, str(tmp_path / "packed"), columns, order, shaped=shaped, packed=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(packed) > 2 and all(n.endswith(".gz") for n in packed)
    joined = lambda folder, names: b"".join((tmp_path / folder / n).read_bytes() for n in names)
    assert gzip.decompress(joined("packed", packed)) == joined("plain", plain)
    assert len(joined("packed", packed)) < len(joined("plain", plain)) / 3
    lines = lambda folder: sorted(tuple(r) for r in exports.read_export(spark, str(tmp_path / folder)).select("line", F.col("file") == 0).collect())
    assert lines("packed") == lines("plain")


def test_runs_keep_result_and_last_error(spark):
    schema = "category string, election_date date, status string, at timestamp, sequence bigint, result string, last_error string"
    events = spark.createDataFrame([("camera", DAY, "running", AT[0], 1, None, None), ("camera", DAY, "failed", AT[1], 2, "{}", "no page")], schema)
    empty = events.where("false").select("category", "election_date", "status", F.col("at").alias("started_at"), F.col("at").alias("completed_at"))
    ledger = queue.ledger_merge(empty, events)
    assert [(r["status"], r["result"], r["last_error"]) for r in ledger.collect()] == [("failed", "{}", "no page")]
    later = spark.createDataFrame([("camera", DAY, "complete", AT[2], 3, '{"pages": 4}', None)], schema)
    assert [(r["status"], r["result"], r["last_error"]) for r in queue.ledger_merge(ledger, later).collect()] == [("complete", '{"pages": 4}', None)]


def test_source_addresses_reach_the_queue(spark):
    items = spark.createDataFrame([("camera", DAY, 1, "p:roma|roma", "pending"), ("camera", DAY, 1, "p:rieti|rieti", "pending"), ("camera", DAY, 1, "p:x|bari", "pending")],
                                  "category string, election_date date, round bigint, municipality_key string, status string")
    stored = spark.createDataFrame([("camera", DAY, "p:roma|roma", True, AT[0], ["u"]), ("camera", DAY, "rieti", False, AT[0], ["v", "w"])],
                                   "category string, election_date date, verification_key string, complete_set boolean, verified_at timestamp, source_urls array<string>")
    got = {r.municipality_key: (r.status, r.source_urls) for r in queue.apply_verifications(items, stored).collect()}
    assert got == {"p:roma|roma": ("verified", ["u"]), "p:rieti|rieti": ("partial", ["v", "w"]), "p:x|bari": ("pending", None)}


def test_a_written_stage_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}

    before = files()
    rows = stage(spark.range(3000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(20):
        left = files() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert rows.count() == 7
