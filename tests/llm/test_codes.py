import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urna.llm import codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, near int, entry int, n long"


def lloyd(rows, entries=256, rounds=4, parts=4):
    """Plain rounds over (vec_id, vector, label): every part against every entry."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(1024 * x) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for i in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    return [
        (vec_id, "".join(f"{i:02x}" for _, i in f), e, sums[label], digest)
        for (vec_id, _, label), f, e in zip(kept, found, error, strict=True)
    ]


def _order(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA)


def test_plain_rounds(spark):
    random = np.random.default_rng(1)
    rows = [(int(i), random.normal(0, 1, 8).round(1).tolist(), int(i) % 3) for i in range(300)]
    rows += [(i, v, label) for i, v, label in rows[:5]]
    got = codes.codes(_frame(spark, rows).repartition(3)).collect()
    assert _order(got) == _order(lloyd(rows))


def test_odd_vectors(spark):
    big = 2**55 + 1
    rows = [
        (7, [0.5, -0.5, 1.0, 2.0], None), (None, [0.5, 0.5, 1.0, 2.0], 1), (big, [0.0, 0.0, 0.0, 0.0], None),
        (3, None, 1), (4, [None, 1.0, 1.0, 1.0], 1), (5, [float("nan"), 1.0, 1.0, 1.0], 2), (6, [float("-inf"), 1.0, 1.0, 1.0], 2),
        (8, [0.5, -0.5, 1.0, 2.0], 1), (8, [0.5, -0.5, 1.0, 2.0], 1),
    ]
    got = codes.codes(_frame(spark, rows)).collect()
    assert _order(got) == _order(lloyd(rows))
    assert {r.vec_id for r in got} == {7, None, big, 8}
    # Vectors of another length come back without a code.
    more = codes.codes(_frame(spark, [*rows, (9, [1.0], 4), (10, [], 5)])).collect()
    assert [(r.code, r.error) for r in more if r.vec_id in (9, 10)] == [(None, None)] * 2
    assert _order(r for r in more if r.vec_id not in (9, 10)) == _order(got)
    assert codes.codes(_frame(spark, rows[3:6])).count() == 0
    assert codes.codes(_frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        codes.codes(_frame(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)]))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(1, 3))
def test_active_entries_equal_a_full_scan(seed, entries, width):
    random = np.random.default_rng(seed)
    parts = random.integers(-3, 4, (40, width))
    before = random.integers(-3, 4, (entries, width))
    after = before.copy()
    moved = random.random(entries) < 0.4
    after[moved] += random.integers(-1, 2, (int(moved.sum()), width))
    near, far = codes.scan(parts, before)
    got = codes.reassign(parts, near, far, after, (after != before).any(axis=1))
    for own, plain in zip(got, codes.scan(parts, after), strict=True):
        assert (own == plain).all()


def test_products_beyond_doubles():
    a = np.array([[2**26, -(2**26)], [3, 4]])
    assert codes.distances(a, a).tolist() == [[0, (2**26 - 3) ** 2 + (2**26 + 4) ** 2], [(2**26 - 3) ** 2 + (2**26 + 4) ** 2, 0]]


def test_a_round_compares_moved_entries_only(monkeypatch):
    """What kept its entry is compared with as many entries as moved."""
    asked = []
    plain = codes.distances
    monkeypatch.setattr(codes, "distances", lambda p, e: asked.append((len(p), len(e))) or plain(p, e))
    parts, book = np.arange(10).reshape(-1, 1), np.array([[0], [4], [9]])
    near, far = codes.scan(parts, book)
    moved = np.array([False, True, False])
    asked.clear()
    codes.reassign(parts, near, far, np.array([[0], [5], [9]]), moved)
    assert sorted(asked) == [(int((near == 1).sum()), 3), (int((near != 1).sum()), 1)]
