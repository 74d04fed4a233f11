"""Language-model scoring by online logistic context mixing.

Text is a sequence of tokens: words (A-Z in lower case), then one end. A token is
spelt as its bytes and a closing blank; the end is the empty word. Every bit is
predicted by several hashed contexts: the place in the word, the last one, two,
three and five bytes, and all of the word so far. A predictor counts the bits seen
in its slot; its estimate is what an online average with step 1/n holds, and that
is a sum, so shards of the corpus combine exactly. The estimates are mixed in the
logistic domain by weights that a gate selects (how often the longest contexts
were seen, and the place of the bit), learnt online; an adaptive table refines
the mixed probability per gate. While the mixer learns on a token, that token's
own occurrence is taken out of the counts, as if predicted before it was learnt.

Documents refine that further, for words recur within a text more than over the
corpus: after i tokens, c of them equal to the next, its probability is
(c + a * p) / (i + a) with p what the predictors give, mixed over the strengths a
in ``STRENGTHS`` by how well each told the text so far. The product over a text
depends only on its counts, so it is exact without walking the text again.

The bits' contexts end at a word's border, so p is computed once a word, however
often it occurs. The work is laid out so that only distinct
words of a batch of texts travel: batches hand in their words, the vocabulary is
counted over the whole corpus, scored, and sent back to the batches, which add up
their documents. A word that all texts hold is one row a batch.

The word before is a context too, of whole words: every pair of neighbours in the
training texts is counted (the first word follows a start of its own), in tables
keyed by a 56-bit hash of the pair that grow with the corpus. After a word seen n
times, s of them before the next one, that has (s + b * p) / (n + b), mixed over the
strengths b in ``PAIR_STRENGTHS`` by how well each told the text so far; the words the
text has shown refine this q in place of p, token by token. A text's probability is
the mean of the two, with the word before and without it. Batches hand in their
distinct pairs in ``SLICES`` by hash, and each slice answers with the pairs' counts.

The mixer learns from every training token: a word's occurrences weigh the bits of
its spelling, those of a frequent word in shares of at most ``SHARE_TOKENS`` (one of
``MOST_SHARES`` beyond that). Shares are dealt to learners of some ``LEARNER_ROWS`` by
hash, and their weights averaged by tokens. What is bounded is the predictors' tables
(``SLOTS``). Counts cover all training texts.

Defined cases: a training text's own words and pairs are in the counts; null and empty texts are one end token (``bits_per_byte`` null);
equal texts score alike; repeated rows are scored each; with nothing to train on
every base score is 0 a token and the model has no counts; a row with a null
doc_id is trained on and not held out; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import crc_mod, discard, mix, only, ship, split_words, stage

#: Bits of each context's table: place, one, two, three, five bytes, whole word.
SLOTS = (12, 16, 18, 20, 22, 23)
ORDERS = len(SLOTS)
#: Tokens of one word that the mixer learns from together, and most shares of a word.
SHARE_TOKENS, MOST_SHARES = 64, 256
#: Shares a learner has, about, shares of a step, and most passes of a learner that has few.
LEARNER_ROWS, STEP, EPOCHS = 1 << 17, 2048, 3
#: Characters of text in one batch of documents.
BATCH_CHARS = 8_000_000
#: Added to both counts of a slot.
DELTA = 0.15
#: Strengths of the predictors against the words a document has shown, equally likely at its start.
STRENGTHS = (10, 30, 100, 300, 1_000, 3_000, 10_000, 30_000, 100_000)
#: Strengths of what is known without the word before against the words seen after it.
PAIR_STRENGTHS = (1, 10, 100, 1_000, 10_000)
#: Slices of pairs by hash, as a power of two: each is counted at once.
SLICES = 10
#: Tokens of several documents that are walked at once.
WALKED = 1 << 18
#: Hash of what comes before the first word.
START = np.uint64(0x2545F4914F6CDD1D)
#: Buckets of the adaptive table.
STEPS = 33
LAST = np.int64(2**63 - 1)

# Counts of a slot as one byte: exact to 32, then eight steps an octave.
_VALUES = np.concatenate([np.arange(33.0), 32 * 2 ** (np.arange(1, 224) / 8)])
_CLASS = np.searchsorted([0.5, 2.5, 8.5, 64.5], _VALUES[:, None] + _VALUES[None, :])
#: Gates: class of the whole word's slot, whether it is of one mind, class of the five-byte slot, place of the bit.
GATES = 5 * 2 * 5 * 8


def _code(n: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(_VALUES, n * 1.0001, side="right") - 1, 0, 255).astype(np.uint8)


def _stretches(less: int) -> np.ndarray:
    """Logit by (zeros, ones) codes; ``less`` 1 or 2: without one zero or one one."""
    zeros, ones = np.meshgrid(_VALUES, _VALUES, indexing="ij")
    zeros = np.maximum(zeros - (less == 1), 0)
    ones = np.maximum(ones - (less == 2), 0)
    return np.clip(np.log((ones + DELTA) / (zeros + DELTA)), -12, 12).astype(np.float32).ravel()


class Spelling:
    """Words as a padded matrix, walked byte by byte in lockstep."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.lengths.max(initial=0)) + 1
        self.matrix = np.zeros((len(words), width), np.uint8)
        inside = np.arange(width)[None, :] < self.lengths[:, None]
        self.matrix[inside] = np.frombuffer(b"".join(words), np.uint8)
        self.matrix[np.arange(len(words)), self.lengths] = 0x20

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(rows, place of the bit, bit, slots by order) for the eight bits of every byte, all first bits first."""
        rows = np.arange(len(self.lengths))
        recent = np.zeros(len(rows), np.uint64)
        whole = np.zeros(len(rows), np.uint64)
        eight = np.arange(8, dtype=np.uint64)[:, None]
        for place in range(self.matrix.shape[1]):
            active = self.lengths[rows] >= place
            rows, recent, whole = rows[active], recent[active], whole[active]
            byte = self.matrix[rows, place].astype(np.uint64)
            contexts = [
                np.full(len(rows), min(place, 15), np.uint64),
                recent & np.uint64(0xFF), recent & np.uint64(0xFFFF), recent & np.uint64(0xFFFFFF),
                recent & np.uint64(0xFFFFFFFFFF), whole,
            ]
            # The bits before each bit, below a one.
            turned = ((byte | np.uint64(256)) >> (np.uint64(8) - eight)) * np.uint64(0xD6E8FEB86659FD93)
            slots = []
            for order, (context, size) in enumerate(zip(contexts, SLOTS, strict=True)):
                base = (context + np.uint64(order + 1)) * np.uint64(0x9E3779B97F4A7C15)
                base ^= base >> np.uint64(29)
                slots.append(((base + turned) * np.uint64(0xA0761D6478BD642F) >> np.uint64(64 - size)).astype(np.int64).ravel())
            bit = byte >> (np.uint64(7) - eight) & np.uint64(1)
            yield rows, np.repeat(np.arange(8), len(rows)), bit.astype(np.int64).ravel(), slots
            recent = recent << np.uint64(8) | byte
            whole = (whole + byte + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB)
            whole ^= whole >> np.uint64(31)


def _sorted_chunks(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for start in range(0, len(order), size):
        yield order[start : start + size]


class Model:
    """Frozen predictors (codes of zeros << 8 | ones, by order), mixer and adaptive table."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.weights = np.full((GATES, ORDERS + 1), 0.3, np.float64)
        self.weights[:, -1] = 0
        self.squared = np.full((GATES, ORDERS + 1), 1e-4)
        grid = np.linspace(-8, 8, STEPS)
        self.ones = np.tile(2 / (1 + np.exp(-grid)), (GATES // 8, 1))
        self.total = np.full((GATES // 8, STEPS), 2.0)

    def _inputs(self, k: np.ndarray, slots: list[np.ndarray], bit: np.ndarray | None, stretch: np.ndarray):
        """Logits of the predictors and the gate; ``bit``: take one occurrence of it out.

        ``stretch``: logits by code; with ``bit`` those without a zero, then those without a one.
        """
        codes = [table[s] for table, s in zip(self.tables, slots, strict=True)]
        if bit is None:
            x = [stretch[c] for c in codes]
            seen = [codes[-1], codes[-2]]
        else:
            x = [stretch[c + (bit << 16)] for c in codes]
            step = np.where(bit == 1, 1, 256)
            small = lambda c: np.where(np.where(bit == 1, c & 255, c >> 8) > 0, c - step, c)
            seen = [small(codes[-1].astype(np.int64)), small(codes[-2].astype(np.int64))]
        long, middle = _GATE[seen[0]], _CLASS.ravel()[seen[1]]
        gate = (long * 5 + middle) * 8 + k
        return np.stack([*x, np.ones(len(gate), np.float32)], axis=1), gate

    def _cell(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the adaptive table below each logit, and the share of the one above."""
        at = (np.clip(logit, -7.999, 7.999) + 8) * (STEPS - 1) / 16
        low = at.astype(np.int64)
        return low, at - low

    def _refined(self, logit: np.ndarray, gate: np.ndarray, rate: np.ndarray) -> np.ndarray:
        low, share = self._cell(logit)
        g = gate // 8
        return rate[g, low] * (1 - share) + rate[g, low + 1] * share

    def learn(self, words: list[bytes], times: np.ndarray | None = None, epochs: int = EPOCHS) -> None:
        """Online passes over training words in a shuffled order; ``times``: tokens each stands for, or one."""
        times = np.ones(len(words)) if times is None else np.asarray(times, np.float64)
        stretch = np.concatenate([_stretches(1), _stretches(2)])
        random = np.random.default_rng(17)
        for epoch in range(epochs):
            order = random.permutation(len(words))
            for start in range(0, len(order), STEP):
                chunk = order[start : start + STEP]
                weight = times[chunk]
                # A gate belongs to one place of the bit, so the eight of a byte learn apart from each other.
                for rows, k, bit, slots in Spelling([words[i] for i in chunk]).places():
                    w = np.tile(weight[rows], 8)
                    x, gate = self._inputs(k, slots, bit, stretch)
                    logit = np.clip(np.einsum("ij,ij->i", self.weights[gate], x), -16, 16)
                    p = 1 / (1 + np.exp(-logit))
                    step = w * (bit - p)
                    gradient = np.stack([np.bincount(gate, step * x[:, j], GATES) for j in range(ORDERS + 1)], axis=1)
                    self.squared += gradient**2
                    self.weights += 0.06 * (0.5**epoch) * gradient / np.sqrt(self.squared)
                    if epoch == epochs - 1:
                        at, share = self._cell(logit)
                        at += gate // 8 * STEPS
                        for column, part in ((at, w * (1 - share)), (at + 1, w * share)):
                            self.ones += np.bincount(column, part * bit, self.ones.size).reshape(self.ones.shape)
                            self.total += np.bincount(column, part, self.total.size).reshape(self.total.shape)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability."""
        stretch, rate, out = _stretches(0), self.ones / self.total, np.zeros(len(words))
        for chunk in _sorted_chunks(words, 4096):
            total = np.zeros(len(chunk))
            for rows, k, bit, slots in Spelling([words[i] for i in chunk]).places():
                x, gate = self._inputs(k, slots, None, stretch)
                logit = np.clip(np.einsum("ij,ij->i", self.weights[gate], x), -16, 16)
                p = 1 / (1 + np.exp(-logit))
                # Both estimates are of the bit being one, so their mean is a probability too.
                p = 0.5 * p + 0.5 * self._refined(logit, gate, rate)
                p = np.clip(p, 1e-7, 1 - 1e-7)
                total[rows] += np.log10(np.where(bit == 1, p, 1 - p)).reshape(8, -1).sum(axis=0)
            out[chunk] = total
        return out


_ONE_MIND = (np.minimum(_VALUES[:, None], _VALUES[None, :]) < 0.5).astype(np.int64)
_GATE = (_CLASS * 2 + _ONE_MIND).ravel()


def _pack(arrays: list[np.ndarray]) -> bytes:
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.copy() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, p) for a, p in zip(arrays, planes, strict=True)]))


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(p.T).view(d).ravel() for d, p in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function from 1 on: Stirling's series beyond a shift by eight."""
    product, y = np.ones_like(x), np.minimum(x, 8.0)
    for i in range(8):
        product *= np.where(x < 8, y + i, 1.0)
    x = np.where(x < 8, x + 8, x)
    square = x**-2
    series = (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def urn(document: np.ndarray, count: np.ndarray, lp: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 probability of each document from its different words.

    ``document``, ``count``, ``lp``: of each different word of a document, which
    document, how often, and log10 by the predictors; ``length``: tokens by document.
    """
    plain = np.bincount(document, lp, len(length)) * np.log(10)
    more = np.flatnonzero(count > 1)
    again, times, p = document[more], count[more].astype(np.float64), 10.0 ** lp[more]
    each = np.bincount(document, minlength=len(length))
    ways = []
    for a in STRENGTHS:
        repeats = np.bincount(again, _log_gamma(a * p + times) - _log_gamma(a * p + 1), len(length))
        ways.append(plain + each * np.log(a) + repeats + _log_gamma(np.full(len(length), float(a))) - _log_gamma(a + length.astype(np.float64)))
    ways = np.stack(ways)
    best = ways.max(axis=0)
    return (best + np.log(np.exp(ways - best).mean(axis=0))) / np.log(10)


def walk(document: np.ndarray, token: np.ndarray, lp: np.ndarray, seen: np.ndarray, before: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 probability of each document, token by token with the word before.

    Of each token, documents one after the other: which document, which word, log10 by
    the predictors, how often the pair with the word before was seen, and that word;
    ``length``: tokens by document.
    """
    ends = np.cumsum(length)
    if len(length) > 1 and len(token) > WALKED:
        # Documents at a time, so that what is held beside them stays small.
        edges = np.flatnonzero(np.diff(ends // WALKED, prepend=-1, append=-1))
        parts = [(a, b, ends[a] - length[a], ends[b - 1]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if len(parts) > 1:
            return np.concatenate([walk(document[s:e] - a, token[s:e], lp[s:e], seen[s:e], before[s:e], length[a:b]) for a, b, s, e in parts])
    told, p = lp * np.log(10), 10.0 ** lp
    known = seen > 0
    ways = np.empty((len(PAIR_STRENGTHS), len(token)))
    for way, b in zip(ways, PAIR_STRENGTHS, strict=True):
        way[:] = told + np.log(b)
        way[known] = np.log(seen[known] + b * p[known])
        way -= np.log(before + b)
    # A document by itself: its sums do not depend on the others of its batch.
    for start, end in zip(ends - length, ends, strict=True):
        np.cumsum(ways[:, start:end], axis=1, out=ways[:, start:end])
    best = ways.max(axis=0)
    so_far = best + np.log(np.exp(ways - best).mean(axis=0))
    del ways, best
    q = np.diff(so_far, prepend=0.0)
    q[ends - length] = so_far[ends - length]
    order = np.argsort(document << 32 | token, kind="stable")
    key = (document << 32 | token)[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    shown = np.empty(len(token), np.int64)
    shown[order] = np.arange(len(token)) - np.repeat(starts, np.diff(np.append(starts, len(token))))
    again = np.flatnonzero(shown)
    owner, times, own = document[again], shown[again].astype(np.float64), np.exp(q[again])
    first = np.bincount(document, np.where(shown == 0, q, 0.0), len(length))
    new = length - np.bincount(owner, minlength=len(length))
    ways = []
    for a in STRENGTHS:
        more = np.bincount(owner, np.log(times + a * own), len(length))
        ways.append(first + new * np.log(a) + more + _log_gamma(np.full(len(length), float(a))) - _log_gamma(a + length.astype(np.float64)))
    ways = np.stack(ways)
    best = ways.max(axis=0)
    return (best + np.log(np.exp(ways - best).mean(axis=0))) / np.log(10)


def _pairs(token: np.ndarray, length: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, distinct pairs, pair) of the tokens of documents one after the other; ``words`` stands before a first one."""
    before = np.empty(len(token), np.int64)
    before[1:] = token[:-1]
    before[np.cumsum(length) - length] = words
    return before, *_numbered(before << 32 | token)


def _in_slices(pairs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each pair, pairs in the order of their slices, where each slice begins) of a batch's pairs and words' hashes."""
    known = np.append(hashes, START)
    hashed = mix(mix(known)[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + known[pairs & 0xFFFFFFFF]) >> np.uint64(8)
    own = (hashed >> np.uint64(56 - SLICES)).astype(np.uint16)
    order = np.argsort(own, kind="stable")
    return hashed, order, np.searchsorted(own[order], np.arange((1 << SLICES) + 1))


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and the number of each value's own."""
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return key[new], number


def hand_in(docs: DataFrame, held_out) -> DataFrame:
    """Two kinds of rows in one written table.

    (batch, idx, word, trained): the different words of a batch, the end as the
    empty word, and their occurrences in training texts. (batch, texts): per batch
    its documents, their tokens as numbers of the batch's words, and these words' hashes.
    """

    def parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in frame["text"]])
        for _, part in frame.groupby(size // BATCH_CHARS, sort=True):
            yield part

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        for frame in (part for whole in frames for part in parts(whole)):
            batch = task << 24 | number
            number += 1
            own = [split_words(t) for t in frame["text"]]
            length = np.fromiter((len(w) + 1 for w in own), np.int64, len(own))
            tokens, different = pd.factorize(np.array([w for ws in own for w in (*ws, b"")], dtype=object))
            size = np.fromiter((len(t.encode()) if isinstance(t, str) else 0 for t in frame["text"]), np.int64, len(own))
            del own
            held = frame["held_out"].to_numpy(bool)
            trained = np.bincount(tokens, np.repeat(~held, length), len(different)).astype(np.int64)
            order = np.argsort(-np.bincount(tokens, minlength=len(different)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different[order]), np.uint64, len(order))
            texts = _pack([frame["doc_id"].to_numpy(np.int64), held.astype(np.uint8), length, size, place[tokens], hashes])
            del tokens, hashes
            yield pd.DataFrame({"batch": [batch], "idx": [-1], "word": [None], "trained": [0], "texts": [texts]})
            for start in range(0, len(order), 65536):
                part = order[start : start + 65536]
                yield pd.DataFrame(
                    {"batch": batch, "idx": np.arange(start, start + len(part)), "word": different[part], "trained": trained[part], "texts": None}
                )

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(LAST))).alias("doc_id"), "text",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    return stage(rows.mapInPandas(run, "batch bigint, idx int, word binary, trained bigint, texts binary"))


def pair_counts(handed: DataFrame) -> DataFrame:
    """(to, slice, counts): for every batch and slice, how often training texts hold each of its pairs."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, blob in (pair for frame in frames for pair in zip(frame["batch"], frame["texts"], strict=True)):
            _, held, length, _, token, hashes = _unpack(blob)
            pairs, pair = _pairs(token.astype(np.int64), length, len(hashes))[1:]
            often = np.bincount(pair, np.repeat(held == 0, length), len(pairs)).astype(np.int32)
            del token, pair
            hashed, order, edges = _in_slices(pairs, hashes)
            some = np.flatnonzero(np.diff(edges))
            blobs = [_pack([hashed[x], often[x]]) for x in (order[edges[s] : edges[s + 1]] for s in some)]
            yield pd.DataFrame({"batch": batch, "slice": some, "pairs": blobs})

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        own = [_unpack(blob) for blob in frame["pairs"]]
        _, pair = _numbered(np.concatenate([hashed for hashed, _ in own]))
        total = np.bincount(pair, np.concatenate([often for _, often in own])).astype(np.int64)[pair]
        ends = np.cumsum([len(hashed) for hashed, _ in own])
        return pd.DataFrame({"to": frame["batch"], "slice": frame["slice"], "counts": [_pack([x]) for x in np.split(total, ends[:-1])]})

    asked = handed.where(F.col("texts").isNotNull()).select("batch", "texts").mapInPandas(ask, "batch bigint, slice int, pairs binary")
    return stage(asked.groupBy("slice").applyInPandas(count, "to bigint, slice int, counts binary"))


def predictors(vocabulary: DataFrame) -> list[np.ndarray]:
    """Counted tables of all contexts over the training tokens, as codes."""
    slice_bits = 16

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Whole numbers: small ones would be lost on large ones that are not.
        counts = [np.zeros(2 << size, np.uint32) for size in SLOTS]
        some = False
        for frame in frames:
            words, times = frame["word"].tolist(), frame["c"].to_numpy(np.uint32)
            some = some or len(words) > 0
            for chunk in _sorted_chunks(words, 4096):
                weight = times[chunk]
                for rows, _, bit, slots in Spelling([words[i] for i in chunk]).places():
                    w = np.tile(weight[rows], 8)
                    for own, slot in zip(counts, slots, strict=True):
                        np.add.at(own, slot << 1 | bit, w)
        if not some:
            return
        for order, size in enumerate(SLOTS):
            step = 1 << min(size, slice_bits)
            for s in range(0, 1 << size, step):
                both = counts[order][2 * s : 2 * (s + step)].reshape(-1, 2).T
                if both.any():
                    at = np.flatnonzero(both).astype(np.uint32)
                    blob = _pack([np.diff(at, prepend=np.uint32(0)), both.ravel()[at].astype(np.uint32)])
                    yield pd.DataFrame({"piece": [order << 20 | s // step], "counts": [blob]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for piece, blob in zip(frame["piece"], frame["counts"], strict=True):
                size = 2 << min(SLOTS[piece >> 20], slice_bits)
                steps, values = _unpack(blob)
                own = held.setdefault(piece, np.zeros(size))
                own[np.cumsum(steps, dtype=np.uint32)] += values
        for piece, own in held.items():
            zeros, ones = _code(own.reshape(2, -1))
            codes = zeros.astype(np.uint16) << 8 | ones
            yield pd.DataFrame({"piece": [piece], "codes": [_pack([codes])]})

    # Rows of a few bytes: tasks are few, so that their tables (of fixed size) are few.
    counted = vocabulary.where("c > 0").mapInPandas(count, "piece int, counts binary")
    merged = counted.repartition("piece").mapInPandas(merge, "piece int, codes binary")
    tables = [np.zeros(1 << size, np.uint16) for size in SLOTS]
    for r in merged.toLocalIterator():
        order, s = r.piece >> 20, r.piece & ((1 << 20) - 1)
        codes = _unpack(bytes(r.codes))[0]
        tables[order][s * len(codes) : (s + 1) * len(codes)] = codes
    return tables


def shares(vocabulary: DataFrame) -> DataFrame:
    """(word, share, times): every training token once, a frequent word in several rows."""
    n = F.least(F.ceil(F.col("c") / SHARE_TOKENS), F.lit(MOST_SHARES))
    split = vocabulary.where("c > 0").select("word", "c", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("share"))
    return split.select("word", "share", (F.col("c") / F.col("n")).alias("times"))


def train(vocabulary: DataFrame) -> Model:
    """Predictors over the whole vocabulary, then the mixer over all training tokens."""
    model = Model(predictors(vocabulary))
    shared = vocabulary.sparkSession.sparkContext.broadcast(model.tables)
    dealt = shares(vocabulary)
    learners = max(1, -(-dealt.count() // LEARNER_ROWS))
    dealt = dealt.withColumn("learner", F.pmod(F.xxhash64("word", "share", F.lit(9)), F.lit(learners)))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["word", "share"])
        own = Model(shared.value)
        ones, total, tokens = own.ones.copy(), own.total.copy(), frame["times"].sum()
        own.learn(frame["word"].tolist(), frame["times"].to_numpy(), min(EPOCHS, -(-LEARNER_ROWS // (2 * len(frame)))))
        # The adaptive table's start counts once, however many learners there are.
        state = np.concatenate([[tokens], (own.weights * tokens).ravel(), (own.ones - ones).ravel(), (own.total - total).ravel()])
        return pd.DataFrame({"state": [state]})

    # Added up by Spark: the driver gets one state, however many learners there are.
    learnt = dealt.groupBy("learner").applyInPandas(learn, "state array<double>").select(F.posexplode("state"))
    summed = learnt.groupBy("pos").agg(F.sum("col").alias("own")).orderBy("pos").toPandas()["own"].to_numpy(np.float64)
    if len(summed):
        sizes = (1, model.weights.size, model.ones.size, model.total.size)
        tokens, weights, ones, total = np.split(summed, np.cumsum(sizes)[:-1])
        model.weights = weights.reshape(model.weights.shape) / tokens
        model.ones = model.ones + ones.reshape(model.ones.shape)
        model.total = model.total + total.reshape(model.total.shape)
    return model


def score(docs: DataFrame, held_out) -> DataFrame:
    """Every document's scores; ``held_out``: a condition on the rows not learnt from."""
    spark = docs.sparkSession
    ship(spark)
    handed = hand_in(docs, held_out)
    paired = pair_counts(handed)
    asked = handed.where(F.col("word").isNotNull()).select("batch", "idx", "word", "trained")
    vocabulary = stage(asked.groupBy("word").agg(F.sum("trained").alias("c")))
    n, v = vocabulary.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(vocabulary)
    shared = spark.sparkContext.broadcast(model)

    def price(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(lp=shared.value.log10(frame["word"].tolist()))

    priced = vocabulary.mapInPandas(price, "word binary, c bigint, lp double")
    # Written first: sorted by word, it is small, and the join's shuffle files are gone before batches get their rows.
    answers = stage(asked.select("batch", "idx", "word").join(priced, "word").select(F.col("batch").alias("to"), "idx", "c", "lp"))
    discard(vocabulary)

    def add_up(texts: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        answer = answer.sort_values("idx")
        c, lp = answer["c"].to_numpy(np.float64), answer["lp"].to_numpy()
        counts = [_unpack(blob)[0] for blob in texts[texts["slice"] >= 0].sort_values("slice")["texts"]]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        out = []
        for blob in texts.loc[texts["slice"] < 0, "texts"]:
            doc_id, held, length, size, token, hashes = _unpack(blob)
            token, document = token.astype(np.int64), np.repeat(np.arange(len(doc_id)), length)
            add = lambda x: np.bincount(document, x, len(doc_id))
            before, different, pair = _pairs(token, length, len(c))
            seen = np.empty(len(different))
            seen[_in_slices(different, hashes)[1]] = np.concatenate(counts)
            # As many texts start as end.
            after = np.append(c, c[token[length[0] - 1]])
            sequence = walk(document, token, lp[token], seen[pair], after[before], length)
            key, word = _numbered(document << 32 | token)
            count = np.bincount(word)
            alone = urn(key >> 32, count, lp[key & 0xFFFFFFFF], length)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": doc_id, "held_out": held.astype(bool), "n_tokens": length,
                        "n_known": add(c[token] > 0).astype(np.int64), "train_tokens": n,
                        "base_score": add(base[token]), "score": (np.logaddexp(sequence * np.log(10), alone * np.log(10)) - np.log(2)) / np.log(10),
                        "n_bytes": size,
                    }
                )
            )
        return pd.concat(out)

    own = handed.where(F.col("texts").isNotNull()).select("batch", F.lit(-1).alias("slice"), "texts")
    done = (
        own.unionByName(paired.select(F.col("to").alias("batch"), "slice", F.col("counts").alias("texts"))).groupBy("batch")
        .cogroup(answers.groupBy("to"))
        .applyInPandas(
            add_up,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double, n_bytes bigint",
        )
    )
    return done.select(
        F.nullif("doc_id", F.lit(int(LAST))).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id as text) mod 5 is not 1, and score all."""
    return score(only(docs, "doc_id", "text"), crc_mod("doc_id", 5) == 1)
