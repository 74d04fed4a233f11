import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from urna.llm import queries, tokencount

PATH = public_tokenizers.path(queries.PIECES)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCORES = tokencount.load(PATH)
COUNTER = tokencount.Counter(SCORES, tokencount.prove(SCORES))


def test_whole_table_equals_the_library(spark, small):
    got = {r.doc_id: r for r in queries.op12_token_counts(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n = len(MODEL.encode(text or "", num_threads=1))
        assert (got[doc_id].n_tokens, got[doc_id].n_bytes) == (n, len((text or "").encode()))
        assert got[doc_id].over_limit == (n > 4096)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = tokencount.count_tokens(odd_docs, PATH, limit=5).collect()
    texts = [r.text for r in odd_docs.select("text").collect()]
    expected = [(len((t or "").encode()), len(MODEL.encode(t or ""))) for t in texts]
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted(expected)
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)
    assert tokencount.count_tokens(no_docs, PATH).count() == 0


def test_large_ids_beside_null(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a"), (None, "b c"), (big + 1, None)], "doc_id bigint, text string").coalesce(1)
    got = [(r.doc_id, r.n_tokens) for r in tokencount.count_tokens(docs, PATH).collect()]
    assert got == [(big, 1), (None, 2), (big + 1, 0)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'stheain1é漢!Z_-▁<>\0🙂​")), st.characters(codec="utf-8")), max_size=60))
def test_any_text_equals_the_library(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))


@pytest.mark.parametrize("text", ["ab" * 60_000, " " * 5000, "the " * 50_000, "日本語" * 20_000])
def test_long_texts(text, monkeypatch):
    expected = len(MODEL.encode(text))
    assert COUNTER.count(text) == expected
    monkeypatch.setattr(tokencount, "AT_ONCE", 10)
    assert COUNTER.count(text) == expected


def test_only_unproven_pre_tokens_are_merged():
    counter = tokencount.Counter(SCORES, tokencount.prove(SCORES))
    assert counter.count("the house and the garden in the town") == 8 and counter.merged == 0
    counter.count("qzxqzx the qzxqzx")
    assert counter.merged == 1


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 500)
    counter = tokencount.Counter(SCORES, tokencount.prove(SCORES))
    text = " ".join(f"zq{i}x" for i in range(2000))
    assert counter.count(text) == len(MODEL.encode(text))
    assert len(counter) - len(counter.proven) < 200


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(tokencount, "MARK", "e")
    with pytest.raises(ValueError):
        tokencount.load(PATH)
