import numpy as np
import xxhash
from pyspark.sql import functions as F

from urna.llm import queries, simhash


def _brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute(rows):
    """(doc_id, fingerprint, component) by comparing everything with everything."""
    prints = [_brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, f"{p:016x}", least.get(find(i), -1)) for i, (d, p) in enumerate(zip(ids, prints, strict=True)))


def _got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in df.collect())


def test_whole_table_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(queries.op10_simhash(spark, small)) == _brute(rows)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert _got(simhash.near_duplicates(odd_docs)) == _brute(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def _chain(n):
    """Random fingerprints with planted chains: each next one a few bits away."""
    random = np.random.default_rng(5)
    out = list(random.integers(0, 2**64, n, dtype=np.uint64))
    for start in range(0, n, 50):
        x = int(out[start])
        for _ in range(30):
            for b in random.choice(64, int(random.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.append(np.uint64(x))
    return np.unique(np.array(out, np.uint64))


def _all_pairs(fp):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= simhash.RADIUS
    a, b = np.nonzero(near)
    return simhash.components(len(fp), a, b)


def test_pruned_search_loses_no_pair():
    fp = _chain(2500)
    assert (simhash.linked(fp, np.arange(len(fp)), simhash.RADIUS) == _all_pairs(fp)).all()


def test_many_shards_join_at_their_borders(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 150)
    fp = _chain(1500)
    nodes = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(fp)], "fp bigint, first bigint")
    got = {r.fp: r.component for r in simhash.classes(nodes).collect()}
    label = _all_pairs(fp)
    assert [got[int(x.view(np.int64))] for x in fp] == label.tolist()


def test_one_document_of_each_class_stays(spark, odd_docs):
    kept = simhash.representatives(odd_docs.where(F.col("doc_id").isNotNull()))
    assert kept.columns == odd_docs.columns
    rows = simhash.near_duplicates(odd_docs.where(F.col("doc_id").isNotNull())).collect()
    assert sorted({r.component_id for r in rows}) == sorted({r.doc_id for r in kept.collect()})
