"""Large ids beside a null keep all their digits, in every operator and the pipeline."""

import corpus_pipeline
import pytest

from urna.llm import bpe, codes, decontaminate, extract, mixing, neighbours, quality, queries, resample, shards, simhash, substring, tokencount, warc
from urna.llm.common import new_folder

BIG = 2**60 + 1
IDS = [BIG, None, BIG + 1, 7]
TEXTS = ["one good text about the town and its river, long enough to be one", None, "another text with other words, of which none is in the first", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "it", "s", len(t or "")) for i, t in zip(IDS, TEXTS, strict=True)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


def _ids(df, column="doc_id"):
    return sorted(r[column] for r in df.collect() if r[column] is not None)


@pytest.mark.parametrize("name", ["op1", "op3", "op5", "op8", "encode", "op9", "op10", "op12", "op13"])
def test_documents(spark, docs, name):
    path, pattern = queries.vocabulary()
    labels = spark.createDataFrame([(7, 1)], "doc_id bigint, quality int")
    import public_tokenizers

    done = {
        "op1": lambda: substring.digests(docs), "op3": lambda: shards.assign(docs), "op5": lambda: quality.classify(docs, labels),
        "op8": lambda: bpe.digests(docs, path, pattern), "encode": lambda: bpe.decode(bpe.encode(docs, path, pattern), path),
        "op9": lambda: mixing.score_documents(docs), "op10": lambda: simhash.near_duplicates(docs),
        "op12": lambda: tokencount.count_tokens(docs, public_tokenizers.path(queries.PIECES)),
        "op13": lambda: resample.draw(docs, docs.select("text"), 100, 1),
    }[name]()
    assert _ids(done) == [7, BIG, BIG + 1] and done.count() == 4


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><p>{t}</p></article>") for i, t in zip(IDS, TEXTS, strict=True)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    assert _ids(extract.extract(pages), "page_id") == [7, BIG, BIG + 1]
    assert _ids(warc.read(warc.write(pages, new_folder(spark, "ids"))), "page_id") == [7, BIG, BIG + 1]


def test_vectors_and_pairs(spark, docs):
    vectors = spark.createDataFrame([(i, [1.0, float(n), 2.0, 0.5], n) for n, i in enumerate(IDS)], "vec_id bigint, embedding array<double>, label int").coalesce(1)
    assert _ids(codes.codes(vectors), "vec_id") == [7, BIG, BIG + 1]
    found = neighbours.search(vectors, every=7).collect()
    assert {r.query_id for r in found} == {i for i in (7, BIG, BIG + 1) if i % 7 == 0} and {r.vec_id for r in found} <= {7, BIG, BIG + 1}
    items = spark.createDataFrame([(BIG, TEXTS[0]), (None, "x y z")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(BIG, BIG)]


def test_pipeline_stages(spark, docs, small):
    """Whatever a stage keeps, it keeps with its id."""
    for name, stage in corpus_pipeline.STAGES:
        kept = _ids(stage(spark, docs, small))
        assert set(kept) <= {7, BIG, BIG + 1}, name
        if name not in ("quality", "decontamination"):
            assert kept == [7, BIG, BIG + 1], name


@pytest.mark.parametrize("html", [[None, None], ["", None], ["plain text", "more"], ["<article>only an article</article>"]])
def test_pages_without_anything_to_count(spark, html):
    pages = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(html)], "page_id bigint, url string, html string").coalesce(1)
    want = [(h or "").replace("<article>", "").replace("</article>", "") for h in html]
    assert [r.text for r in extract.extract(pages).orderBy("page_id").collect()] == want


def test_ranges_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, "http://h.example/", f"<p>{i}</p>" * 50) for i in range(64)], "page_id bigint, url string, html string")
    archives = warc.write(pages.repartition(4), new_folder(spark, "ranges"))
    done = warc.read(archives, split=512)
    assert done.rdd.getNumPartitions() > 8 and done.count() == 64


def test_a_worker_remembers_a_bounded_number_of_bytes(monkeypatch):
    path, pattern = queries.vocabulary()
    monkeypatch.setattr(bpe, "REMEMBERED", 200_000)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)
    coder = bpe.TextCoder(open(path, "rb").read(), pattern)
    most = 0
    # Double blanks: these texts cannot be cut at blanks, only into their matches.
    for _ in coder.encode(f"word{i}  and  some  more{i}\n  " * 20 for i in range(2000)):
        most = max(most, coder.held)
    assert most < 200_000 + 20_000 * 40
