"""Imports lose no archive, double no row, and replace what an archive had."""

import datetime as dt
import zipfile

from urna.operators import coverage
from urna.operators import facts as reads
from urna.sinks import tables
from urna.sources import archives as zips
from urna.sources import registry
from urna.streaming.ingest import ingest_archives

DAY, LATER = dt.date(1994, 3, 27), dt.date(1996, 4, 21)


def _catalogue(spark):
    rows = [("1994/a.zip", "camera", DAY), ("1994/b.zip", "camera", DAY), ("1996/a.zip", "camera", LATER), ("undated.zip", "senato", None),
            ("twice.zip", "camera", DAY), ("twice.zip", "senato", DAY)]
    return spark.createDataFrame(
        [(a, a.split("/")[-1], c, d, f"https://x/{a}", a[::-1]) for a, c, d in rows],
        "archive string, filename string, category string, election_date date, download_url string, sha256 string",
    )


def test_archives_meet_their_own_entry_or_are_rejects(spark):
    paths = ["file:/in/1994/a.zip", "file:/in/1994/b.zip", "file:/in/1996/a.zip", "file:/in/orphan.zip", "file:/in/undated.zip", "file:/in/twice.zip"]
    rows = spark.createDataFrame([(p, i) for p in paths for i in range(2)], "path string, row_number int")
    matched, rejects = zips.with_election(rows, _catalogue(spark))
    got = sorted((r.archive, r.election_date, r.row_number) for r in matched.collect())
    assert got == [("1994/a.zip", DAY, 0), ("1994/a.zip", DAY, 1), ("1994/b.zip", DAY, 0), ("1994/b.zip", DAY, 1), ("1996/a.zip", LATER, 0), ("1996/a.zip", LATER, 1)]
    assert {r.path.split("/")[-1]: r.error for r in rejects.collect()} == {
        "orphan.zip": "not in the catalogue", "undated.zip": "no election date in the catalogue", "twice.zip": "several elections in the catalogue",
    }


def test_two_archives_of_one_election(spark):
    facts = spark.createDataFrame(
        [(a, "camera", DAY, "LAZIO", m, m.lower()) for a, m in (("1994/a.zip", "ROMA"), ("1994/b.zip", "LATINA"))],
        "archive string, category string, election_date date, region string, municipality string, municipality_key string",
    )
    catalogue = _catalogue(spark).where("election_date = '1994-03-27' and archive like '1994%'")
    joined = reads.with_archive(facts, catalogue).collect()
    assert sorted((r.archive, r.download_url) for r in joined) == [("1994/a.zip", "https://x/1994/a.zip"), ("1994/b.zip", "https://x/1994/b.zip")]
    asked = spark.createDataFrame([("LAZIO", "ROMA")], "region string, municipality string")
    found = {r.filename: (r.stato, r.righe_comune) for r in coverage.municipality_coverage(facts, catalogue, asked).collect()}
    assert found == {"a.zip": ("present", 1), "b.zip": ("missing", 0)}


def test_reimport_without_rows_leaves_none(spark, tmp_path):
    schema = "category string, election_date date, archive string, votes int"
    both = spark.createDataFrame([("camera", DAY, "a b.zip", 1), ("camera", DAY, "c.zip", 2)], schema)
    tables.replace_archives({"t": both}, str(tmp_path), both)
    tables.replace_archives({"t": both.limit(0)}, str(tmp_path), both.where("votes = 1"))
    assert [(r.archive, r.votes) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("c.zip", 2)]
    path = str(tmp_path / "closures")
    tables.replace_elections(both, path)
    tables.replace_elections(both.limit(0), path, both)
    assert not list((tmp_path / "closures").glob("category=*/election_date=*"))


def test_ingest_writes_catalogue_rejects_and_empties(spark, tmp_path):
    def put(name, text):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as z:
            z.writestr("r.csv", text)

    (tmp_path / "in").mkdir()
    put("a.zip", "comune;lista;voti_lista\nROMA;A;5\n")
    put("empty.zip", "comune;lista;voti_lista\n")
    put("orphan.zip", "comune;lista;voti_lista\nROMA;A;5\n")
    (tmp_path / "in" / "broken.zip").write_bytes(b"no archive")
    catalogue = spark.createDataFrame([("a.zip", "camera", DAY), ("empty.zip", "senato", DAY), ("broken.zip", "europee", DAY)], "filename string, category string, election_date date")
    ingest_archives(spark, str(tmp_path / "in"), catalogue, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    listed = {r.archive: (r["rows"], len(r.sha256)) for r in spark.read.parquet(str(tmp_path / "out" / "catalogue")).collect()}
    assert listed == {"a.zip": (1, 64), "empty.zip": (0, 64)}
    rejects = spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()
    assert sorted(r.path.split("/")[-1] for r in rejects) == ["broken.zip", "orphan.zip"]


def test_malformed_words_are_kept_aside(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "p-7.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t96.5\tROMA\n" + "5\tx\t1\n")
    words, lines = registry.read_words(spark, str(tmp_path))
    assert [(r.page, r.text) for r in words.collect()] == [(7, "ROMA")]
    assert [r.line for r in lines.collect()] == ["5\tx\t1"]


def test_files_are_loaded_with_their_digest(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"abc")
    held, rejects = zips.load(spark, str(tmp_path))
    assert [(bytes(r.content), len(r.sha256)) for r in held.collect()] == [(b"abc", 64)] and rejects.isEmpty()
