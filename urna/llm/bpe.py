"""Byte-level BPE encoding and decoding.

Texts are cut by the vocabulary's split pattern and every match is merged on its
own. Matches not seen before in a batch are merged together: bucketed by byte
length and laid out as a padded matrix of ids, one match a row. Each round looks
up all adjacent pairs in a hashed pair table, every row merges its leftmost pair
of the least rank, and the rows are compacted; rows without a known pair leave.

Defined cases: a null or empty text has no tokens and decodes to no bytes;
repeated rows and equal texts are encoded alike, every row for itself; a table
without rows gives none; further columns are ignored by ``encode``; a match of
any length is encoded whole (beyond ``LONGEST`` bytes by a heap of pairs, which
follows the same rule in n log n steps).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import kept, ship

#: Upper byte lengths of the matrix buckets.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
LONGEST = BUCKETS[-1]
#: Rows of one matrix, bytes that a worker remembers, characters encoded together: bounds of memory, not of the work.
MATRIX_ROWS, REMEMBERED, BLOCK_CHARS = 1 << 14, 1 << 26, 1 << 22

NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, with the tables that the matrix rounds need."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        self._table(np.array(keys, dtype=np.uint64), np.array(ranks, dtype=np.int32))

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing, filled and later probed in bulk."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.pair_ranks = np.full(1 << bits, NONE, dtype=np.int32)
        slots, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = self.pair_ranks[at] == NONE
            first = np.zeros(len(waiting), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]] = keys[waiting[put]]
            self.pair_ranks[at[put]] = ranks[waiting[put]]
            waiting = waiting[~put]
            moved = self.keys[slots[waiting]] != keys[waiting]
            slots[waiting] = np.where(moved, (slots[waiting] + 1) & self.mask, slots[waiting])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where there is none or an id is padding (-1)."""
        known = right >= 0
        keys = (left[known].astype(np.uint64) << np.uint64(32)) | right[known].astype(np.uint64)
        slots = self._slot(keys)
        found = np.full(len(keys), NONE, dtype=np.int32)
        asking = np.arange(len(keys))
        while len(asking):
            at = slots[asking]
            rank, hit = self.pair_ranks[at], self.keys[at] == keys[asking]
            found[asking[hit]] = rank[hit]
            slots[asking] = (at + 1) & self.mask
            asking = asking[~hit & (rank != NONE)]
        out = np.full(left.shape, NONE, dtype=np.int32)
        out[known] = found
        return out

    def merge_rows(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a matrix of byte ids padded with -1."""
        done: list = [None] * len(matrix)
        row = np.arange(len(matrix))
        while len(matrix):
            ranks = self.lookup(matrix[:, :-1], matrix[:, 1:])
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(matrix), np.int64)
            best = ranks[np.arange(len(matrix)), at] if ranks.shape[1] else np.full(len(matrix), NONE)
            over = best == NONE
            for i in np.flatnonzero(over):
                ids = matrix[i]
                done[row[i]] = ids[ids >= 0]
            matrix, at, best, row = matrix[~over], at[~over], best[~over], row[~over]
            if not len(matrix):
                break
            # Compaction: from the merged pair on, every cell takes its right neighbour.
            column = np.arange(matrix.shape[1] - 1)
            shorter = np.where(column[None, :] > at[:, None], matrix[:, 1:], matrix[:, :-1])
            shorter[np.arange(len(matrix)), at] = best
            width = int((shorter >= 0).sum(axis=1).max())
            matrix = shorter[:, :width]
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long match: a heap of (rank, place) over a linked list of ids."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        tokens, ranks = self.tokens, self.ranks

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(tokens[ids[i]] + tokens[ids[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each match."""
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.searchsorted(BUCKETS, lengths)
        for b in np.unique(bucket):
            chosen = np.flatnonzero(bucket == b)
            if b == len(BUCKETS):
                for i in chosen:
                    out[i] = self.merge_long(pieces[i])
                continue
            for start in range(0, len(chosen), MATRIX_ROWS):
                part = chosen[start : start + MATRIX_ROWS]
                flat = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                matrix = np.full((len(part), int(lengths[part].max())), -1, dtype=np.int32)
                matrix[np.arange(matrix.shape[1])[None, :] < lengths[part][:, None]] = flat
                for i, ids in zip(part, self.merge_rows(matrix), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        """The bytes that a sequence of ids stands for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


class TextCoder:
    """Encodes texts with one vocabulary, remembering the matches it has met."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.odd_space = regex.compile(r"\s ")
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0

    def _runs(self, text: str) -> list[str]:
        """Parts of a text whose matches are those of the text.

        A single space before anything else opens a match, so a text whose spaces all
        follow a non-space can be cut there; other texts are cut into their matches,
        each of which is one match by itself as well.
        """
        if self.odd_space.search(text) or text.endswith(" "):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, runs: set[str]) -> None:
        """Encode what is new among ``runs``; ids as text, their number, and decoded bytes."""
        new = [r for r in runs if r not in self.known]
        for start in range(0, len(new), MATRIX_ROWS):
            self._learn(new[start : start + MATRIX_ROWS])

    def _learn(self, new: list[str]) -> None:
        cut = [self.pattern.findall(r) for r in new]
        pieces = list({p for c in cut for p in c})
        ids = dict(zip(pieces, self.vocabulary.encode_pieces([p.encode("utf-8") for p in pieces]), strict=True))
        decode = self.vocabulary.decode
        for run, parts in zip(new, cut, strict=True):
            own = [i for p in parts for i in ids[p].tolist()]
            self.known[run] = made = (",".join(map(str, own)), len(own), decode(own))
            # Four bytes a character at most, and what the objects themselves take.
            self.held += 4 * len(run) + len(made[0]) + len(made[2]) + 300

    def encode(self, texts: Iterable[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text its runs' ids (as text), number of ids, and decoded bytes."""
        block, size = [], 0
        for text in texts:
            block.append(self._runs(text) if text else [])
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self._flush(block)
                block, size = [], 0
        yield from self._flush(block)

    def _flush(self, block):
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        self.learn({r for runs in block for r in runs})
        known = self.known
        for runs in block:
            yield [known[r] for r in runs]


def coder_of(ranks: bytes, pattern: str) -> TextCoder:
    """The coder a worker process uses: building one takes half a second."""
    return kept((hashlib.sha256(ranks).digest(), pattern), lambda: TextCoder(ranks, pattern))


def _coded(ranks: bytes, pattern: str, with_ids: bool):
    """A function of texts, as a column; ids of rows stay in Spark, as pandas would make floats of them beside a null."""
    kind = "token_ids array<int>, decoded binary" if with_ids else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    @F.pandas_udf(kind)
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = coder_of(ranks, pattern)
        for column in columns:
            texts = (t if isinstance(t, str) else "" for t in column)
            rows = []
            for parts in coder.encode(texts):
                joined = ",".join([p[0] for p in parts])
                decoded = b"".join([p[2] for p in parts])
                count = sum([p[1] for p in parts])
                if with_ids:
                    rows.append((np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32), decoded))
                else:
                    rows.append((count, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            names = ["token_ids", "decoded"] if with_ids else ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pd.DataFrame(rows, columns=names)

    return run


def _vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """Token ids of every whole text and the bytes they decode to.

    ``vocabulary`` is the path of a rank file on the driver; its content, a fixed
    size, travels with the tasks.
    """
    ship(docs.sparkSession)
    run = _coded(_vocabulary_bytes(vocabulary), pattern, True)
    return docs.select(id_column, run("text").alias("coded")).select(id_column, "coded.*")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encode`` with ids and decoded bytes as digests: nothing large leaves the tasks."""
    ship(docs.sparkSession)
    run = _coded(_vocabulary_bytes(vocabulary), pattern, False)
    return docs.select("doc_id", run("text").alias("coded")).select("doc_id", "coded.*")


def decode(tokens: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """Bytes of every sequence of ids in ``token_ids``; null decodes to no bytes."""
    ship(tokens.sparkSession)
    ranks = _vocabulary_bytes(vocabulary)

    @F.pandas_udf("binary")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Vocabulary(ranks)
        for column in columns:
            yield pd.Series([known.decode(x if x is not None else ()) for x in column], dtype=object)

    return tokens.select(id_column, run("token_ids").alias("decoded"))
