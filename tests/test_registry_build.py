from pyspark.sql import functions as F

from urna.operators.registry_build import college_entries, registry_rows

LINES = [
    # Section 1, LAZIO: its colleges 1 and 2; section 2 carries its numbers on; section 3 belongs elsewhere.
    ("m", 1, 1, 7, 1, "ANAGNI"), ("m", 1, 1, 7, 2, "( RM-MONTI )"), ("m", 1, 1, 7, 3, "( PRATI )"), ("m", 1, 1, 7, 4, "VITERBO-ZONA 1"), ("m", 1, 1, 8, 5, "( TRASTEVERE )"),
    ("m", 1, 2, 8, 6, "ALATRI"), ("m", 1, 2, 8, 7, "PONT-CANAVESE"), ("m", 1, 2, 8, 8, "( BORGO )"),
    ("m", 2, 1, 9, 9, "Comprende i seguenti comuni: Anagni, Ferentino e Alatri. Il resto"), ("m", 2, 1, 9, 10, "e parte del territorio del comune di Romo, delimitata,"),
    ("m", 2, 1, 9, 11, "FERENTIHO"), ("m", 2, 1, 9, 12, "ZZZZZZZ"),
    ("m", 3, 1, 10, 13, "ISERNIA"), ("m", 4, 1, 11, 14, "ATTI DEL GOVERNO"),
]
REFERENCE = [
    ("m", "LAZIO", "Roma", "1"), ("m", "LAZIO", "ROMA", "2"), ("m", "LAZIO", "VITERBO", "3"), ("m", "LAZIO", "ANAGNI", None), ("m", "LAZIO", "ALATRI", "3"),
    ("m", "LAZIO", "FERENTINO", "3"), ("m", "MOLISE", "ISERNIA", "1"), ("other", "MOLISE", "ANAGNI", "1"), ("m", None, "X", "1"),
]


def frames(spark, lines=LINES):
    return (
        spark.createDataFrame(lines, "map_version string, section int, college int, page int, line_no int, line string"),
        spark.createDataFrame(REFERENCE, "map_version string, geography string, name string, college string"),
    )


def test_rows_of_a_registry(spark):
    rows = registry_rows(*frames(spark)).collect()
    got = sorted((r.geography, r.college, r.source_page, r.entry_type, r.municipality, r.ocr_text) for r in rows)
    assert got == sorted([
        ("LAZIO", 1, 7, "whole", "ANAGNI", "ANAGNI"), ("LAZIO", 1, 7, "zone", "ROMA", "( RM-MONTI )"),
        # A bracket alone inherits; a prefix names a city in one piece; after it the only split city with a code stands in.
        ("LAZIO", 1, 7, "zone", "ROMA", "( PRATI )"), ("LAZIO", 1, 7, "zone", "VITERBO", "VITERBO-ZONA 1"), ("LAZIO", 1, 8, "zone", "ROMA", "( TRASTEVERE )"),
        # A hyphenated name is no zone; the second college starts without a city of its own.
        ("LAZIO", 2, 8, "whole", "ALATRI", "ALATRI"), ("LAZIO", 2, 8, "whole", "", "PONT-CANAVESE"), ("LAZIO", 2, 8, "zone", "ROMA", "( BORGO )"),
        ("LAZIO", 3, 9, "whole", "ANAGNI", "Anagni"), ("LAZIO", 3, 9, "whole", "FERENTINO", "Ferentino"), ("LAZIO", 3, 9, "whole", "ALATRI", "Alatri"),
        ("LAZIO", 3, 9, "described_part", "ROMA", "parte del territorio del comune di Romo"),
        ("LAZIO", 3, 9, "whole", "FERENTINO", "FERENTIHO"), ("LAZIO", 3, 9, "whole", "", "ZZZZZZZ"),
        ("MOLISE", 1, 10, "whole", "ISERNIA", "ISERNIA"),
    ])
    by_text = {r.ocr_text: r for r in rows}
    assert by_text["( RM-MONTI )"].entry_text == "MONTI" and by_text["VITERBO-ZONA 1"].entry_text == "ZONA 1" and by_text["ANAGNI"].entry_text == ""
    assert by_text["parte del territorio del comune di Romo"].entry_text.startswith("Comprende i seguenti comuni")
    assert (by_text["FERENTIHO"].match_score, by_text["ZZZZZZZ"].match_score, by_text["( PRATI )"].match_score) == (0.889, 0.0, 1.0)


def test_entries_keep_their_order_and_page(spark):
    lines, _ = frames(spark)
    found = sorted((r.position.part, r.position["at"], r.name, r.page) for r in college_entries(lines.where("section = 2")).collect())
    assert found == [(0, 0, "ANAGNI", 9), (0, 1, "FERENTINO", 9), (0, 2, "ALATRI", 9), (1, 0, "ROMO", 9), (2, 11, "FERENTIHO", 9), (2, 12, "ZZZZZZZ", 9)]


def test_empty_tables(spark):
    lines, reference = frames(spark)
    assert registry_rows(lines.limit(0), reference).count() == 0
    assert registry_rows(lines, reference.limit(0)).count() == 0


def test_a_long_college_is_read_once(spark):
    """A text that describes 6,000 cities twice: reading it again for every city took minutes."""
    import time

    n = 6000
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    said = [("m", 1, 1, 1, i, f"Comprende il comune di {letters(i % n)}, intero") for i in range(2 * n)]
    lines, reference = frames(spark, said + [("m", 1, 1, 1, 2 * n, "ANAGNI")])
    start = time.monotonic()
    found = college_entries(lines).where("kind = 'described_part'").select("position.at", "name", F.length("description").alias("n")).collect()
    took = time.monotonic() - start
    assert [r.name for r in sorted(found)] == [letters(i).upper() for i in range(n)]
    assert {r.n for r in found} == {sum(len(x[5]) + 1 for x in said) + len("ANAGNI")}
    assert took < 40
