import re

import pytest

from urna.llm import decontaminate, queries
from urna.llm.common import read

ITEMS = [
    (1, "A train leaves Paris at 9:30 and drives 120 km to Lyon, then it drives back to Paris within 3 hours. How far did it go in all?"),
    (2, "Short one here."),
    (3, None),
    (4, ""),
    (5, "When Anna has 12 apples and gives Bruno 5 of them, how many apples does Anna keep for her own dinner?"),
    (6, "When Anna has 12 apples and gives Bruno 5 of them, how many apples does Anna keep for her own dinner?"),
    (None, "An item without a number that could be reported is never part of a pair at all."),
]

CASES = [
    # (text, items that leak there, kind)
    ("Some words before. A train leaves Paris at 9:30 and drives 120 km to Lyon, then it drives back to Paris within 3 hours. How far did it go in all? And after.", {1}, "verbatim"),
    ("a train leaves Rome at 7:15 and drives 80 miles to Milan, then it drives back to Rome within 2 hours. How far did it go in all?", {1}, "reparameterised"),
    # Paris comes back as another town than the one it was first.
    ("a train leaves Rome at 7:15 and drives 80 miles to Milan, then it drives back to Turin within 2 hours. How far did it go in all?", set(), None),
    ("when Carla has 40 apples and gives Dario 7 of them, how many apples does Carla keep for her own dinner?", {5, 6}, "reparameterised"),
    ("This says: short one here.", {2}, "verbatim"),
    ("Nothing in this text has been asked before by anyone who writes questions for a living.", set(), None),
    (None, set(), None),
    ("", set(), None),
    ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 km", set(), None),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, t, "a", 1, 2, "k") for i, (t, _, _) in enumerate(CASES)] + [(0, CASES[0][0], "a", 1, 2, "k"), (None, CASES[0][0], "a", 1, 2, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, size int, covered int, kind string")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, key string")
    return docs, items


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_planted_cases(cases, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    docs, items = cases
    got = {}
    for r in decontaminate.leaks(docs, items).collect():
        assert (r.doc_id, r.item_id) not in got
        got[r.doc_id, r.item_id] = r.kind
    want = {(i, j): kind for i, (_, js, kind) in enumerate(CASES) for j in js}
    assert got == want


def test_clean_documents_stay(cases):
    docs, items = cases
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1] + [i for i, (_, js, _) in enumerate(CASES) if not js]


def test_empty_tables(cases):
    docs, items = cases
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def test_no_python_in_the_plan(spark, small):
    plan = queries.op7_benchmark_decontamination(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_table_equals_brute_force(spark, small):
    """Passages of an item of eight words or more, found by comparing text."""
    docs = [tuple(r) for r in read(spark, small, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, small, "benchmark").select("item_id", "text").collect()]
    found = {}
    for r in queries.op7_benchmark_decontamination(spark, small).collect():
        found[r.doc_id, r.item_id] = r
    plain = lambda t: re.findall(r"\w+", t.lower())
    where = {}
    for i, t in items:
        w = plain(t)
        for j in range(len(w) - 7):
            where.setdefault(tuple(w[j : j + 8]), set()).add(i)
    want = set()
    for d, t in docs:
        w = plain(t)
        for j in range(len(w) - 7):
            want |= {(d, i) for i in where.get(tuple(w[j : j + 8]), ())}
    assert want and set(found) == want


AGAIN = [
    # Names of two words.
    ("a train leaves New York at 7:15 and drives 80 miles to Los Angeles, then it drives back to New York within 2 hours. How far did it go in all?", {1}),
    # Words put in: no diagonal covers 13 tokens.
    ("A train leaves Rome at 7:15 and drives about 80 miles to Milan, then it drives back all the way to Rome within 2 hours. How far did it really go in all?", {1}),
    # Different values that meet the same one.
    ("when Carla has 7 apples and gives Dario 7 of them, how many apples does Carla keep for her own dinner?", {5, 6}),
    # Paris meets two towns, of one word and of two.
    ("a train leaves New York at 7:15 and drives 80 miles to Los Angeles, then it drives back to Boston within 2 hours. How far did it go in all?", set()),
]


def test_questions_asked_again_with_other_values(spark, cases):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(AGAIN)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, cases[1]).collect()}
    assert got == {(i, j): "reparameterised" for i, (_, js) in enumerate(AGAIN) for j in js}


def test_items_of_numbers_and_names_are_found_verbatim(spark):
    items = spark.createDataFrame([
        (1, "What is 12 + 45 * 3 - 7?"), (2, "1931 1944 1958 1967 1972 1980 1991 2003 2015"), (3, "from Rome, Milan, Turin, Genoa, Bari, Parma, Siena, Lecce"),
    ], "item_id bigint, text string")
    docs = spark.createDataFrame([
        (0, "He asked: what is 12 + 45 * 3 - 7? Nobody knew."), (1, "he asked: what is 13 + 46 * 4 - 8? Nobody knew."),
        (2, "Years: 1931, 1944, 1958, 1967, 1972, 1980, 1991, 2003, 2015."), (3, "Years: 1932, 1945, 1959, 1968, 1973, 1981, 1992, 2004, 2016."),
        (4, "we went from Rome, Milan, Turin, Genoa, Bari, Parma, Siena, Lecce to the sea"),
        (5, "we went from Oslo, Bergen, Malmo, Turku, Riga, Narva, Kiel, Lund to the sea"),
    ], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(0, 1, "verbatim"), (2, 2, "verbatim"), (4, 3, "verbatim")}


def test_repetitive_texts_take_no_longer_than_their_length(spark):
    """Every place of such a text is a diagonal of its own; slots among them share one reading of the text."""
    import time

    items = spark.createDataFrame(
        [(1, "go " * 30), (2, "row row row your boat row row row your boat row"), (3, "go " * 9 + "7 " + "go " * 9)], "item_id bigint, text string"
    )
    texts = ["go " * 500, "go " * 20_000, "row row row your boat " * 4000, ("go " * 9 + "8 ") * 1500, "x " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = time.time()
    got = {(r.doc_id, r.item_id): (r.covered, r.kind) for r in decontaminate.leaks(docs, items).collect()}
    assert time.time() - start < 90
    assert got[0, 1] == got[1, 1] == (30, "verbatim") and got[2, 2] == (11, "verbatim") and got[3, 3] == (19, "reparameterised")
    assert not any(d == 4 for d, _ in got)
