import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from urna.llm import bpe, common, quality, queries, substring

PATH, PATTERN = queries.vocabulary()


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


REFERENCE = _reference()
CODER = bpe.TextCoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)


def _ids(text):
    parts = next(iter(CODER.encode([text])))
    return [int(x) for p in parts for x in p[0].split(",") if x]


def test_whole_table_equals_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_byte_bpe(spark, small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = REFERENCE.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts(spark, odd_docs, no_docs):
    rows = bpe.encode(odd_docs, PATH, PATTERN).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in rows) == sorted(
        (i if i is not None else -1, (t or "").encode()) for i, t in ((r.doc_id, r.text) for r in texts)
    ) or all(bytes(r.decoded) in {(t.text or "").encode() for t in texts} for r in rows)
    by_text = {(t.text or "").encode(): t.text or "" for t in texts}
    for r in rows:
        assert list(r.token_ids) == REFERENCE.encode_ordinary(by_text[bytes(r.decoded)])
    assert bpe.encode(no_docs, PATH, PATTERN).count() == 0
    again = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(bytes(r.decoded) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r 'stda1é漢!Z_-")), max_size=60))
def test_any_text_equals_the_library(text):
    assert _ids(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_characters_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert _ids(text) == REFERENCE.encode_ordinary(text)


def test_matrix_and_heap_agree():
    random = np.random.default_rng(3)
    vocabulary = CODER.vocabulary
    pieces = [bytes(random.choice(list(b"abcdeth in"), size=n).astype(np.uint8)) for n in random.integers(1, 200, 60)]
    for piece, ids in zip(pieces, vocabulary.encode_pieces(pieces), strict=True):
        assert ids.tolist() == vocabulary.merge_long(piece).tolist()
        assert vocabulary.decode(ids.tolist()) == piece


def test_other_operators_let_a_workers_coder_go():
    ranks = bpe._vocabulary_bytes(queries.vocabulary()[0])
    for other in (lambda: quality._scores(["a text"], np.zeros((1 << 18) + 1)), lambda: list(substring.blocks(["a text"], 13))):
        coder = bpe.coder_of(ranks, queries.vocabulary()[1])
        assert bpe.coder_of(ranks, queries.vocabulary()[1]) is coder
        other()
        assert not common._KEPT
