import hashlib

import corpus_pipeline
from test_resemblance import _brute as near_brute
from test_substring import _brute as window_brute
from urna.llm import queries
from urna.llm.common import new_folder, read


def test_stages_against_brute_force(spark, small):
    docs = read(spark, small, "documents")
    folder, seen = new_folder(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, small)
        if name != "tokens":
            assert done.schema.simpleString() == docs.schema.simpleString()
        done.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        seen.append((name, docs, kept))
        docs = kept
    pairs = lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    stages = {name: (before, after) for name, before, after in seen}

    before, after = stages["quality"]
    quality = {r.doc_id: r.quality for r in read(spark, small, "labels").collect()}
    gone = {i for i, _ in pairs(before)} - {i for i, _ in pairs(after)}
    known = [quality[i] for i in gone if i in quality]
    assert known and sum(known) <= 0.05 * len(known) + 1
    good = [i for i, q in quality.items() if q == 1]
    assert len([i for i in good if i in gone]) <= 0.02 * len(good)

    before, after = stages["near_duplicates"]
    assert [i for i, _ in pairs(after)] == near_brute(pairs(before))

    before, after = stages["substrings"]
    want = {i: (n, gone_, digest) for i, n, gone_, digest in window_brute(pairs(before))}
    texts = dict(pairs(before))
    for i, t in pairs(after):
        _, gone_, digest = want[i]
        assert (t == texts[i]) if not gone_ else hashlib.sha256(t.encode()).hexdigest() == digest
    assert after.count() == before.count()

    before, after = stages["decontamination"]
    from urna.llm import decontaminate

    leaked = {r.doc_id for r in decontaminate.leaks(before, read(spark, small, "benchmark")).collect()}
    assert {i for i, _ in pairs(before)} - {i for i, _ in pairs(after)} == leaked

    before, after = stages["tokens"]
    digests = {r.doc_id: r.decoded_sha256 for r in after.collect()}
    assert digests == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in pairs(before)}


def test_run_is_the_stages_in_turn(spark, small):
    import __spark_entry__ as entry

    rows = entry.queries()["pipeline"](spark, small)
    assert rows.columns == queries.op8_byte_bpe(spark, small).columns
    assert 0 < rows.count() < read(spark, small, "documents").count()


def test_odd_documents_pass_every_stage(spark, odd_docs, small):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            done = stage(spark, rows, small)
            assert name == "tokens" or done.columns == docs.columns
            assert done.count() <= rows.count()
