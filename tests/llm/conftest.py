import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

#: Nulls, empty and very long texts, ties, repeated rows, odd white space, marks and scripts.
TEXTS = [
    (0, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "Alpha   beta\n\n gamma  'tis don't we'll  12345 !!! \r\n\x0b\x0c end "),
    (5, LONG),
    (6, LONG),
    (7, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."),
    (8, "x" * 3000 + "é" * 700),
    (9, "naïve café ÄÖÜ ñandú 漢字かな 🙂🙂     İı İ"),
    (10, "word"),
    (11, "a b"),
    (12, "WORD"),
    (13, "one two three four"),
    (13, "one two three four"),
    (None, "a text without a number that has some words in it"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Extra columns carry names that the operators use themselves."""
    rows = [(i, t, "x", "s0", 7, 0.5, -1, -2, "f", None, 3, 1, 0) for i, t in TEXTS]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, "
        "star bigint, fingerprint string, component_id bigint, batch int, shard int, idx int",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
