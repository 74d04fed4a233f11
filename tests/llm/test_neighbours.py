import numpy as np

from urna.llm import neighbours, queries
from urna.llm.common import read, stage


def _brute(rows, every=50, k=5):
    rows = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    sizes = [len(v) for _, v in rows]
    d = max(set(sizes), key=lambda s: (sizes.count(s), -s)) if sizes else 0
    rows = [(i, v) for i, v in rows if len(v) == d]
    out = {}
    for q, x in rows:
        if q % every == 0 and (q not in out or list(x) == min(list(v) for i, v in rows if i == q)):
            scored = sorted((-float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i) for i, v in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_recall_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    want = _brute([(r.vec_id, r.embedding) for r in read(spark, folder, "embeddings").collect()])
    got = _got(queries.op4_nearest_neighbours(spark, folder))
    assert set(got) == set(want)
    hits = 0
    for q, found in want.items():
        assert len(got[q]) == 5
        truth = dict(found)
        hits += len(truth.keys() & {i for i, _ in got[q]})
        for i, score in got[q]:
            assert i not in truth or abs(truth[i] - score) < 1e-12
    assert hits / sum(map(len, want.values())) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]),
        (6, [inf, 0.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (50, [0.0, -1.0, 0.5]),
        (100, [1.0, 0.0, 0.0]), (9, [1.0, 1.0, 0.0]), (9, [1.0, 1.0, 0.0]), (150, []), (200, None),
    ]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id bigint, embedding array<float>, cell int, block int, score double")
    got, want = _got(neighbours.search(df)), _brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[0]] == [1, 2, 100, 9, 9]
    assert neighbours.search(df.limit(0)).count() == 0
    assert _got(neighbours.search(df.where("vec_id in (0, 1)"))) == {0: [(1, 1.0)]}


def test_many_chunks_and_blocks_change_nothing(spark, small, monkeypatch):
    df = read(spark, small, "embeddings")
    whole = _got(neighbours.search(df, every=7))
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    assert _got(neighbours.search(df, every=7)) == whole


def test_bounds_hold():
    random = np.random.default_rng(1)
    unit = random.standard_normal((4000, 64))
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    index = neighbours.Index(unit[:1000], 1)
    codes, *scalars = index.encode(unit, np.zeros(4000, int))
    guess, error = index.estimate(codes, scalars, 0, unit[:50])
    assert codes.shape == (4000, 8)
    assert (np.abs(guess - unit @ unit[:50].T) <= error).mean() > 0.95


def test_what_leaves_a_bundle_is_k_rows_a_query(spark, monkeypatch):
    # Vectors without structure: bounds alone leave a share of all pairs.
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random.standard_normal((2000, 16)).astype(np.float32))]
    df, written = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), []
    monkeypatch.setattr(neighbours, "CHUNK", 500)

    def counted(table):
        done = stage(table)
        written.append((done.columns, done.count()))
        return done

    monkeypatch.setattr(neighbours, "stage", counted)
    got, want = _got(neighbours.search(df)), _brute(rows)
    pairs = [n for columns, n in written if "query_id" in columns]
    assert pairs and max(pairs) <= 40 * 5 * 5
    found = [(q, i, score) for q, v in got.items() for i, score in v]
    truth = {(q, i): score for q, v in want.items() for i, score in v}
    assert sum((q, i) in truth for q, i, _ in found) / len(truth) >= 0.9
    assert all(abs(truth[q, i] - score) < 1e-12 for q, i, score in found if (q, i) in truth)
