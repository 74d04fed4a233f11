"""Token counts of whole texts by a BPE vocabulary of pieces, without building the tokens.

A text becomes one string: blanks turn into ``MARK``, one more stands before it. It is
cut before every mark that follows another character; the vocabulary is checked to
hold no piece across such a cut, so no merge ever reaches over one and each pre-token
counts by itself.

1. Offline, once a vocabulary: every string of it that can be a pre-token is merged
   alone. Those that end as one token are proven; they are most words of a text.
2. A pre-token that is proven counts one, by a lookup. Only the rest are merged: the
   adjacent pair whose joined string has the highest score goes first, ties from the
   left, until no pair is in the vocabulary. What stays outside the vocabulary is one
   character, counted as its UTF-8 bytes. A worker remembers short ones it has merged,
   up to ``REMEMBERED`` characters in all.

The proven strings and scores are as large as the vocabulary, a parameter; nothing of
the texts is shared or shuffled.

Vocabularies that would count otherwise (a model that is no BPE, rewrites characters,
drops blanks or has no bytes to fall back on) are refused with a ValueError.

Defined cases: null and empty texts have no tokens; blanks alone are marks like any;
strings that look like special tokens are ordinary text; a long run without blanks is
one pre-token merged with a heap, in n log n steps; ids, ties, repeated rows and nulls
stay as they are; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import kept, ship

#: Stands for a blank.
MARK = "▁"
#: Tokens beyond which a text counts as over the limit.
LIMIT = 4096
#: Characters of merged pre-tokens that a worker keeps, and of the longest it keeps.
REMEMBERED, LONGEST = 8_000_000, 64
#: Characters of a text up to which its pre-tokens are listed at once.
AT_ONCE = 1 << 20

_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Texts on which a model that counts otherwise betrays itself.
_PROBES = ("ﬁ Ａ é", "  a  b ", " ", "\t\n x", "<s> </s> <unk> <0x41>", "\U0001f642‍​", "abcabcabc 12345")


def load(path: str) -> dict[str, float]:
    """Piece to score of a model file: what merges may make."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not special(i)}
    if any(model.is_unused(i) for i in ids) or sum(map(model.is_byte, ids)) != 256:
        raise ValueError(f"{path}: unused pieces, or not all bytes are pieces")
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(map(crossing.search, pieces)):
        raise ValueError(f"{path}: a piece reaches over the end of a word")
    counter = Counter(pieces, frozenset())
    for probe in _PROBES:
        if counter.count(probe) != len(model.encode(probe)):
            raise ValueError(f"{path}: not a BPE model that leaves characters as they are")
    return pieces


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The pieces of a string: best pair first, ties from the left."""
    parts: list[str | None] = list(text)
    n = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, str]] = []

    def offer(left: int, right: int) -> None:
        joined = parts[left] + parts[right]
        score = scores.get(joined)
        if score is not None:
            heapq.heappush(heap, (-score, left, joined))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, left, joined = heapq.heappop(heap)
        right = after[left] if parts[left] is not None else n
        # One of the two may have gone into another pair since.
        if right >= n or parts[left] + parts[right] != joined:
            continue
        parts[left], parts[right] = joined, None
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
            offer(left, after[left])
        if before[left] >= 0:
            offer(before[left], left)
    return [p for p in parts if p is not None]


def tokens_of(text: str, scores: dict[str, float]) -> int:
    """Tokens of a pre-token by merging it."""
    return sum(1 if p in scores else len(p.encode("utf-8")) for p in merge(text, scores))


def prove(scores: dict[str, float]) -> frozenset[str]:
    """The strings of the vocabulary that are one token when merged alone.

    Strings without a mark in front are proven as well: a pre-token that starts a
    line or follows a tab has none.
    """
    return frozenset(p for p in scores if merge(p, scores) == [p])


class Counter(dict):
    """Pre-token to tokens; what is not known yet is merged when asked for."""

    def __init__(self, scores: dict[str, float], proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.scores, self.proven, self.held, self.merged = scores, proven, 0, 0

    def __missing__(self, pre_token: str) -> int:
        n = tokens_of(pre_token, self.scores)
        self.merged += 1
        if len(pre_token) <= LONGEST:
            if self.held > REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
                self.held = 0
            self[pre_token] = n
            self.held += len(pre_token)
        return n

    def count(self, text) -> int:
        if not isinstance(text, str) or not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= AT_ONCE:
            return sum(map(self.__getitem__, _CUT.findall(marked)))
        # A long text's pre-tokens are never all held at once.
        return sum(self[m.group()] for m in _CUT.finditer(marked))


def counter_of(name: str, shared) -> Counter:
    """This process's counter; the broadcast is opened once."""
    return kept(("counter", name), lambda: Counter(*shared.value))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row by the model at ``path``."""
    spark = docs.sparkSession
    ship(spark)
    scores = load(path)
    shared = spark.sparkContext.broadcast((scores, prove(scores)))

    @F.pandas_udf("bigint")
    def counted(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(path, shared)
        for texts in columns:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", length.alias("n_bytes"), counted("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
