import hashlib

import numpy as np
import pandas as pd

from urna.llm import queries, substring


def _brute(rows, size=13):
    """(doc_id, n_words, n_removed, digest) by a table of all windows as text."""
    last = 2**63 - 1
    own = [((i if i is not None else last), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in own:
        for j in range(len(w) - size + 1):
            k = b" ".join(w[j : j + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in own:
        gone = set()
        for j in range(len(w) - size + 1):
            if first[b" ".join(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def _got(df):
    return sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_whole_table_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = _brute(rows)
    assert any(r[2] for r in want)
    assert _got(queries.op1_substring_dedup(spark, small)) == want


def test_odd_texts_in_many_batches(spark, odd_docs, no_docs, monkeypatch):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert _got(substring.digests(odd_docs)) == _brute(rows)
    monkeypatch.setattr(substring, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substring, "BLOCK", 40)
    monkeypatch.setattr(substring, "PIECE", 100)
    assert _got(substring.digests(odd_docs)) == _brute(rows)
    assert substring.digests(no_docs).count() == 0


def test_a_crowded_sketch_changes_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(substring, "BATCH_BYTES", 100_000)
    full = substring.deduplicate(docs).toPandas().sort_values("doc_id", ignore_index=True)
    for bits in ((8, 0), (12, 5), (30, 8)):
        other = substring.deduplicate(docs, bits=bits).toPandas().sort_values("doc_id", ignore_index=True)
        assert full.equals(other)


def test_merged_counts_never_fall_short(spark, small):
    """Every batch hears of all its windows that repeat, and of few that do not."""
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    cells, slices = 22, 4
    batches = [list(substring.blocks(texts[b::5], 13)) for b in range(5)]
    by_slice = {}
    for b, own in enumerate(batches):
        for _, edges, low, _ in own:
            for s, once, twice in substring.pieces(substring.distinct(edges, low), cells, slices):
                by_slice.setdefault(s, []).append((b, once, twice))
    heard = {b: [] for b in range(5)}
    for s, parts in by_slice.items():
        for b, found in substring.merged(parts, cells - slices):
            heard[b].append((s, found))
    keys, times = np.unique(np.concatenate([substring.distinct(e, low) for own in batches for _, e, low, _ in own]), return_counts=True)
    single = 0
    for b, own in enumerate(batches):
        said = substring.heard_by(pd.DataFrame(heard[b], columns=["slice", "cells"]), cells, slices)
        all_ = np.concatenate([low for _, _, low, _ in own])
        found = all_[said.repeated(all_)]
        repeats = times[np.searchsorted(keys, all_)] > 1
        assert repeats.any() and np.isin(all_[repeats], found).all()
        single += (~np.isin(all_[~repeats], found)).mean()
    assert single / 5 > 0.8


def test_the_sketch_grows_with_the_corpus():
    before = 0
    for length in (0, 1, 10**6, 10**8, 10**10, 4 * 10**11):
        cells, slices = substring.sketch_bits(length)
        assert cells >= before and 1 << cells >= length // substring.WINDOW_BYTES * 4 and cells - slices <= substring.MOST_BITS
        before = cells
    assert substring.sketch_bits(10**14)[1] <= 14


def test_columns_that_stay(spark, odd_docs):
    kept = substring.deduplicate(odd_docs, keep=("lang", "batch", "idx")).collect()
    assert {(r.lang, r.batch, r.idx) for r in kept} == {("x", 3, 0)} and len(kept) == odd_docs.count()
