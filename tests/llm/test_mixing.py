import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urna.llm import mixing, queries
from urna.llm.common import read


def _base(rows):
    """(held_out, n_tokens, n_known, N, base score) of each row in order, by counting."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    counts = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = []
    for h, ws in zip(held, tokens, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((h, len(ws), sum(counts[w] > 0 for w in ws), n, base))
    return out


def _check(rows, got):
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), *b) for (i, _), b in zip(rows, _base(rows), strict=True))
    have = sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op9_context_mixing(spark, "/root/testdata/sf0.01").collect()


def test_base_scores_equal_counting(spark, scored):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    _check(rows, scored)


def test_held_out_texts_cost_less_than_by_place_alone(scored):
    held = [r for r in scored if r.held_out and r.bits_per_byte is not None]
    bits = sum(-r.score for r in held) * math.log2(10)
    size = sum(-r.score * math.log2(10) / r.bits_per_byte for r in held)
    assert bits / size < 2.6, bits / size


def test_held_out_texts_cost_less_than_by_smoothed_counts(spark):
    """On enough text: with little, unknown words decide, which the base does not spell."""
    held = queries.op9_context_mixing(spark, "/root/testdata/sf0.1").where("held_out")
    r = held.selectExpr("sum(score) AS score", "sum(base_score) AS base", "sum(n_tokens) AS n").first()
    assert r.score > r.base, (r.score / r.n, r.base / r.n)


def test_urn_equals_its_sequence():
    """Token by token in any order, strengths weighed by how well they told the text so far."""
    random = np.random.default_rng(5)
    lp = {"a": -1.0, "b": -2.5, "c": -400.0, "": -0.5}
    for length in (1, 2, 9, 60):
        text = list(random.choice(list(lp), length))
        belief = np.full(len(mixing.STRENGTHS), 1 / len(mixing.STRENGTHS))
        total, seen = 0.0, Counter()
        for i, w in enumerate(text):
            # c's first probability is below the smallest double: its logarithm is added apart.
            ways = np.array([(seen[w] + a * 10 ** lp[w]) / (i + a) for a in mixing.STRENGTHS])
            if w == "c" and not seen[w]:
                scale = np.array([a / (i + a) for a in mixing.STRENGTHS])
                total += lp[w] + math.log10((belief * scale).sum())
                belief = belief * scale / (belief * scale).sum()
            else:
                total += math.log10((belief * ways).sum())
                belief = belief * ways / (belief * ways).sum()
            seen[w] += 1
        count = Counter(text)
        got = mixing.urn(np.zeros(len(count), int), np.array(list(count.values())), np.array([lp[w] for w in count]), np.array([length]))
        assert math.isclose(got[0], total, rel_tol=1e-9)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = mixing.score_documents(odd_docs).collect()
    _check(rows, got)
    empty = {r.score for r in got if r.n_tokens == 1}
    assert len(empty) == 1 and all(r.score < 0 for r in got)
    assert all((r.bits_per_byte is None) == (r.doc_id in (1, 2)) for r in got)
    assert mixing.score_documents(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id bigint, text string")
    for r in mixing.score_documents(docs).collect():
        assert r.held_out and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score)


def test_token_probabilities_sum_to_at_most_one():
    """Over all tokens of two letters or less, with a model of random counts."""
    random = np.random.default_rng(2)
    tables = [random.integers(0, 1 << 12, 1 << s).astype(np.uint16) for s in mixing.SLOTS]
    model = mixing.Model(tables)
    model.learn([b"ab", b"b", b"", b"abc"] * 20, epochs=1)
    letters = [bytes([b]) for b in range(256) if b != 0x20]
    one = 10 ** model.log10([b"", *letters])
    two = 10 ** model.log10([a + b for a, b in itertools.product(letters, letters)])
    assert one.sum() + two.sum() <= 1 + 1e-9


def test_batches_do_not_matter(spark, small):
    docs = read(spark, small, "documents")
    key = lambda df: sorted((r.doc_id, round(r.score, 6), round(r.base_score, 6)) for r in df.collect())
    whole = key(mixing.score_documents(docs))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert key(mixing.score_documents(docs.repartition(5))) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mixer_learns_from_every_training_token(spark):
    """The adaptive table counts the bits it has learnt from: all of all tokens, whatever their number."""
    counts = {b"a": 200_000, b"bc": 3, b"": 70, b"seldom": 1}
    vocabulary = spark.createDataFrame([(w, c) for w, c in [*counts.items(), (b"unseen", 0)]], "word binary, c bigint")
    assert {bytes(r.word): r.n for r in mixing.shares(vocabulary).groupBy("word").agg({"times": "sum"}).toDF("word", "n").collect()} == counts
    model = mixing.train(vocabulary)
    learnt = model.total.sum() - mixing.Model(model.tables).total.sum()
    assert math.isclose(learnt, sum(8 * (len(w) + 1) * c for w, c in counts.items()))


def test_walk_equals_its_sequence():
    """Token by token, both kinds of strengths weighed by how well they told the text so far."""
    random = np.random.default_rng(6)
    words = list(range(6))
    lp, pair = random.uniform(-6, -0.5, len(words)), random.integers(0, 4, (len(words) + 1, len(words)))
    pair[:, 2] = 0
    before = pair.sum(axis=1)
    texts = [random.choice(words, n) for n in (1, 2, 30, 80)]
    want = []
    for text in texts:
        near, strong = np.full(len(mixing.PAIR_STRENGTHS), 1 / len(mixing.PAIR_STRENGTHS)), np.full(len(mixing.STRENGTHS), 1 / len(mixing.STRENGTHS))
        total, seen, last = 0.0, Counter(), len(words)
        for i, w in enumerate(text):
            ways = np.array([(pair[last, w] + b * 10 ** lp[w]) / (before[last] + b) for b in mixing.PAIR_STRENGTHS])
            q = (near * ways).sum()
            near = near * ways / q
            ways = np.array([(seen[w] + a * q) / (i + a) for a in mixing.STRENGTHS])
            total += math.log10((strong * ways).sum())
            strong = strong * ways / (strong * ways).sum()
            seen[w] += 1
            last = w
        want.append(total)
    length, token = np.array([len(t) for t in texts]), np.concatenate(texts)
    last, _, _ = mixing._pairs(token, length, len(words))
    got = mixing.walk(np.repeat(np.arange(len(texts)), length), token, lp[token], pair[last, token], before[last], length)
    assert np.allclose(got, want, rtol=1e-9)


def test_words_in_their_order_cost_less(spark):
    """Held-out texts of trained phrases against the same words shuffled, which have the same base score."""
    random = np.random.default_rng(7)
    phrases = [[f"w{x}" for x in random.integers(0, 500, 12)] for _ in range(40)]
    rows, held = [], [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1][:20]
    for i in range(200):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            rows.append((i, " ".join(w for p in random.integers(0, 40, 10) for w in phrases[p])))
    for i, j in zip(held[::2], held[1::2], strict=True):
        text = [w for p in random.integers(0, 40, 10) for w in phrases[p]]
        rows += [(i, " ".join(text)), (j, " ".join(random.permutation(text)))]
    got = {r.doc_id: r for r in mixing.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    for i, j in zip(held[::2], held[1::2], strict=True):
        assert math.isclose(got[i].base_score, got[j].base_score, rel_tol=1e-9)
        assert got[i].score > got[j].score + 20


def test_pairs_of_all_training_texts_are_counted(spark):
    """Copies dealt over batches, with held-out ones that are not counted."""
    docs = spark.createDataFrame([(i, "a b a b c") for i in range(12)], "doc_id bigint, text string").repartition(4)
    rows = mixing.pair_counts(mixing.hand_in(docs, F.col("doc_id") >= 9)).collect()
    counts = Counter(int(n) for r in rows for n in mixing._unpack(bytes(r.counts))[0])
    # start-a, b-a, b-c and c-end once a text, a-b twice; 9 texts, in each of the batches.
    assert len({r.to for r in rows}) > 1 and set(counts) == {9, 18} and counts[9] == 4 * counts[18]
    assert len({r.to for r in rows}) == counts[18]
