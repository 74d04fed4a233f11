import numpy as np

import corpus_pipeline
from urna.llm import resemblance, simhash
from urna.llm.common import components, read


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _brute(rows):
    """Smallest doc_id of each class, by the Jaccard of every pair that shares a shingle."""
    sets, where, pairs = _sets(t for _, t in rows), {}, set()
    for i, s in enumerate(sets):
        for x in s or {None}:
            for j in where.setdefault(x, []):
                pairs.add((j, i))
            where[x].append(i)
    links = [(i, j) for i, j in pairs if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    a, b = (np.array(x, np.int64) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
    label, first = components(len(rows), a, b), {}
    for i, (d, _) in enumerate(rows):
        first[label[i]] = min(first.get(label[i], d), d)
    return sorted(set(first.values()))


def _edited(n, every, seed):
    """A text of n words with one word in ``every`` changed."""
    base = [f"w{x}" for x in np.random.default_rng(3).integers(0, 10**6, n)]
    at = np.random.default_rng(seed).integers(0, every)
    return " ".join(f"x{seed}" if i % every == at else w for i, w in enumerate(base))


def test_whole_table_equals_brute_force(spark, small):
    docs = read(spark, small, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == _brute(rows)


def test_copies_from_a_jaccard_of_08_go(spark):
    """Copies of one text with an edit every so many words: resemblances from 0.5 to 0.98 among each other."""
    rows = [(k, _edited(300, every, k)) for k, every in enumerate([1000, 900, 120, 100, 80, 70, 60, 50, 45, 30, 20, 12, 9, 1000])]
    rows += [(100 + k, _edited(300, 24, 50 + k)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in resemblance.representatives(docs).collect()) == _brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.where("doc_id is not null")
    rows = [tuple(r) for r in named.select("doc_id", "text").collect()]
    kept = resemblance.representatives(named)
    assert kept.schema == named.schema
    assert sorted({r.doc_id for r in kept.collect()}) == _brute(rows)
    assert kept.where("doc_id = 13").count() == 2
    assert resemblance.representatives(no_docs).count() == 0


def test_rows_without_doc_id_stay_once_a_class(spark, odd_docs, small):
    """One row of a class without ids stays, and none where a row of the class has an id."""
    texts = ["a text without a number that has some words in it"] * 3 + ["another one that nobody else has written before"] + ["One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."]
    more = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    for kept in (corpus_pipeline.near_duplicate_stage(spark, docs, small), simhash.representatives(docs)):
        assert sorted(r.text for r in kept.where("doc_id is null").collect()) == sorted({texts[0], texts[3]})
        assert {r.doc_id for r in kept.collect()} >= {0, 4, 8, 9}


def test_signatures_of_near_copies_stay_close():
    """Bits apart follow the Jaccard distance, well inside the limit at 0.8 and well outside at 0.5."""
    random = np.random.default_rng(5)
    for j, inside in ((1.0, True), (0.8, True), (0.5, False)):
        both = random.integers(0, 2**64, 600, dtype=np.uint64)
        n = int(600 * (1 - j) / (2 * j))
        a, b = (np.unique(np.concatenate([both, random.integers(0, 2**64, n, dtype=np.uint64)])) for _ in range(2))
        apart = int(np.bitwise_count((resemblance.signature(a) ^ resemblance.signature(b)).view(np.uint64)).sum())
        assert (apart <= resemblance.APART) == inside
        assert abs(apart - resemblance.BITS * (1 - resemblance.jaccard(a, b)) / 2) < 6 * resemblance.BITS**0.5 / 2


def test_every_pair_that_pivots_leave_is_confirmed(spark, monkeypatch):
    """Texts that differ in some of the same 30 places; few pairs are near, and most of them meet no pivot."""
    monkeypatch.setattr(resemblance, "APART", -1)  # what signatures say decides nothing
    random, rows = np.random.default_rng(8), []
    base = [f"w{x}" for x in random.integers(0, 10**6, 300)]
    for k in range(300):
        edited = {10 * i for i in np.flatnonzero(random.random(30) < 0.5)}
        rows.append((k, " ".join(f"x{i}" if i in edited else w for i, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = _brute(rows)
    assert len(want) < 300
    assert sorted(r.doc_id for r in resemblance.representatives(docs).collect()) == want
    # Parts of a key meet in blocks.
    monkeypatch.setattr(resemblance, "SIDE", 1500)
    assert sorted(r.doc_id for r in resemblance.representatives(docs).collect()) == want
