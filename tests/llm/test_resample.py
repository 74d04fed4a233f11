import hashlib
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urna.llm import queries, resample

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    own = _WORD.findall((text or "").translate(_LOWER))
    return own, [" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]


def plain(docs, target, per_cent=5, least=20):
    """(doc_id, n_features, weight, score, rank) by plain counting and sorting."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    counts = []
    for texts in ([t for _, t in docs], target):
        own = [0] * 10000
        for text in texts:
            for f in plain_features(text)[1]:
                own[bucket(f)] += 1
        counts.append(own)
    s, t = counts
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        own, features = plain_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(own)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * per_cent // 100]
    out, left = [], list(rows)
    for place, r in enumerate(drawn):
        left.remove(r)
        out.append((*r[:4], place + 1))
    return out + [(*r[:4], None) for r in left]


def _order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id bigint, text string, rank int, score string, weight double")


def test_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert _order(queries.op13_importance_resampling(spark, small).collect()) == _order(plain(docs, target))


def test_odd_texts(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    target = spark.createDataFrame([(None,), ("",), ("Alpha beta end x",)], "text string")
    for per_cent, least in ((5, 20), (50, 1), (100, 0)):
        got = resample.draw(odd_docs, target, per_cent, least).collect()
        assert _order(got) == _order(plain(docs, ["Alpha beta end x"], per_cent, least))
    assert resample.draw(no_docs, target).count() == 0
    empty = resample.draw(odd_docs, target.limit(0), 50, 1).collect()
    assert _order(empty) == _order(plain(docs, [], 50, 1))


def test_ties_and_repeated_rows(spark):
    """A third of all rows is one row, at and around the cutoff."""
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(5, text)] * 40 + [(i, text + " more") for i in range(30)] + [(None, text)] * 30 + [(2**60 + 1, text)]
    target = spark.createDataFrame([("w1 w2",)], "text string")
    for per_cent in (1, 10, 35, 40, 41, 75, 100):
        got = resample.draw(_frame(spark, docs).repartition(4), target, per_cent).collect()
        assert _order(got) == _order(plain(docs, ["w1 w2"], per_cent))


def test_bisection_by_counts(spark):
    chance = random.Random(4)
    values = [chance.choice([-(10**12), -5, 0, 1, 1, 1, 7, 10**9, 2**62]) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").cache()
    for wanted in (0, 1, 50, 120, 200):
        cut, above = resample.least_with(rows, F.col("v"), wanted, min(values) - 1, max(values))
        assert above == sum(v > cut for v in values) <= wanted
        assert sum(v > cut - 1 for v in values) > wanted or cut == min(values) - 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=90), max_size=12), st.integers(1, 5))
def test_joined_crcs(own, block):
    before, resample.BLOCK = resample.BLOCK, block
    try:
        got = [int(x) for part in resample.run_buckets(own) for x in part]
    finally:
        resample.BLOCK = before
    expected = [zlib.crc32(b" ".join(own[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(own) - k + 1)]
    assert sorted(got) == sorted(expected)


def test_gains_follow_the_target():
    gain = resample.gains(np.array([10, 0, 5]), np.array([0, 10, 5]))
    assert gain[1] > gain[2] > gain[0]
    assert gain[0] == math.floor(1000 * math.log(1 * 18 / (11 * 18)))
