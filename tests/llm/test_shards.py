import heapq
import random
import zlib

from urna.llm import queries, shards
from urna.llm.common import read


def _heap(sizes, n):
    """Loads after dealing the sizes, largest first, to the least loaded shard."""
    heap = [(0, i) for i in range(n)]
    for s in sorted(sizes, reverse=True):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + s, i))
    return [x for x, _ in sorted(heap, key=lambda p: p[1])]


def _check(rows, texts):
    """Every rule of the result; loads equal the plain heap's."""
    sizes = {}
    for t in texts:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 1
    loads, slots, where = [0] * 8, {}, {}
    for r, t in rows:
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        assert where.setdefault(t or "", r.shard) == r.shard
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert loads == _heap(sizes.values(), 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _joined(df, texts):
    return [(r, texts[r.doc_id]) for r in df.collect()]


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in read(spark, small, "documents").collect()}
    rows = _joined(queries.op3_sharding(spark, small), texts)
    assert len(rows) == len(texts)
    _check(rows, texts.values())


def test_odd_texts(spark, odd_docs, no_docs):
    all_ = odd_docs.select("doc_id", "text").collect()
    rows = _joined(shards.assign(odd_docs), {r.doc_id: r.text for r in all_})
    assert len(rows) == len(all_)
    _check(rows, [r.text for r in all_])
    assert shards.assign(no_docs).count() == 0


def test_classes_end_where_the_heap_does():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 9)
        classes = {draw.randint(1, 400): draw.choice([1, 3, 70, 1000]) for _ in range(draw.randint(1, 25))}
        dealt = shards.schedule(classes.items(), n)
        loads = [0] * n
        for size, _, cuts in dealt:
            for i, c in enumerate(cuts):
                loads[i] += size * (c - (cuts[i - 1] if i else 0))
            assert cuts[-1] == classes[size]
        assert sorted(loads) == sorted(_heap([s for s, c in classes.items() for _ in range(c)], n))
