"""Substring dedup: a count-min prefilter before an exact grouping of windows.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller doc_id.

1. Documents are dealt into batches by hash. Every batch counts its windows into a
   count-min sketch, kept as the sorted cells it touches, and sends it in slices.
   A slice's pieces are merged, cell by cell, and every batch is answered with those
   of its own cells that the merged sketch counts twice or more. A merged cell never
   counts too little, so a window that repeats has both its cells in the answers.
2. A second pass over the batches looks every window up in its answers and hands on
   only those whose estimate is two or more, one row for each different window of a
   batch. These are grouped exactly, by 96 bits of a multilinear hash of 128-bit word
   hashes (at 1.6e13 windows, 100 TB, fewer than 0.002 false meetings are expected in
   all). Windows that were overestimated turn out to be alone there; none that
   repeats is lost.
3. What earlier documents hold goes back to the batch, which applies it.

The sketch has as many cells as the corpus asks for (about ``CELLS`` for each window)
and is nowhere whole: a task holds one slice, a batch its own answers, the driver
three numbers. A window that every document holds is one row and two cells a batch, so
no group exceeds the number of batches. A slice holds some ``SLICE_WINDOWS`` windows.
Slices are twice ``MOST_SLICES`` at most, so that a batch's pieces stay larger than
their rows' overhead, and of 2**``MOST_BITS`` cells: beyond some 400 GB of text cells
fill up, more windows reach the exact grouping, and the result stays the same.

Defined cases: null, empty and short texts lose nothing; a window that repeats
within one document only, or among rows of the same doc_id, does not count; a
null doc_id is after all others; equal rows are all returned; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urna.llm.common import let_go, mix, reading, ship, stage, tidy, words

WINDOW = 13
#: The sketch: rows, cells for each window of the corpus, and bytes of text a window stands for.
ROWS, CELLS, WINDOW_BYTES = 2, 8, 6
#: Slices of a row that are merged apart: windows each should hold, their number, and bits of the cells in one.
SLICE_WINDOWS, MOST_SLICES, MOST_BITS = 1 << 21, 1 << 13, 25
#: Windows that are sent as one sketch.
PIECE = 1 << 21
#: Bytes of text in one batch, on average, and windows of one that are hashed at a time.
BATCH_BYTES, BLOCK = 24_000_000, 1 << 19
#: A doc_id after all others, for null.
LAST = np.int64(2**63 - 1)

_RANDOM = np.random.default_rng(20_13)
_LOW = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(own: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for each window of a list of words."""
    n = len(own) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in own]), np.uint64).reshape(-1, 2)
    first, second = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(size):
        low += first[i : i + n] * _LOW[i]
        high += second[i : i + n] * _HIGH[i]
    return mix(low), (mix(high) >> np.uint64(32)).astype(np.uint32)


def sketch_bits(length: int) -> tuple[int, int]:
    """(bits of a row's cells, bits of its slices) for a corpus of so many bytes."""
    windows = max(1, length // WINDOW_BYTES)
    slices = max(0, min(MOST_SLICES, windows // SLICE_WINDOWS).bit_length())
    inside = max(12, (CELLS * windows - 1).bit_length() - slices)
    return slices + min(MOST_BITS, inside), slices


def _cells(low: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    """Cell of each window in a row of the sketch."""
    turned = mix(low + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64))
    return turned >> np.uint64(64 - cell_bits)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte planes apart: small ones compress to a byte."""
    steps = np.diff(cells, prepend=np.uint64(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """A batch's documents in order; ``own`` is the text as it came."""
    frame = frame.assign(own=frame["text"], text=[t if isinstance(t, str) else "" for t in frame["text"]])
    return frame.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)


def blocks(texts, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, edges, low, high): the windows of some documents at a time, ``BLOCK`` or one document's."""
    let_go()
    held, first, windows = [], 0, 0

    def sent():
        low, high = (np.concatenate([h[k] for h in held]) for k in range(2))
        return first, np.concatenate([[0], np.cumsum([len(x) for x, _ in held])]), low, high

    for i, text in enumerate(texts):
        held.append(window_hashes(words(text), size))
        windows += len(held[-1][0])
        if windows > BLOCK:
            yield sent()
            held, first, windows = [], i + 1, 0
    if held:
        yield sent()


class Answers:
    """What a batch heard of the merged sketch: by row its cells that count two or more."""

    def __init__(self, rows: dict[int, np.ndarray], cell_bits: int):
        self.cell_bits, self.rows = cell_bits, rows
        bits = min(cell_bits, 24)
        self.mask, self.seen = np.uint64((1 << bits) - 1), {}
        for row, known in rows.items():
            # A small bitmap first: few windows need the search.
            some = np.zeros(1 << bits, bool)
            some[known & self.mask] = True
            self.seen[row] = np.packbits(some, bitorder="little")

    def repeated(self, low: np.ndarray) -> np.ndarray:
        """Numbers of the windows that are estimated to occur at least twice."""
        left = np.arange(len(low))
        for row in range(ROWS):
            if row not in self.rows:
                return np.zeros(0, np.int64)
            known, cells = self.rows[row], _cells(low[left], row, self.cell_bits)
            low_bits = cells & self.mask
            some = (self.seen[row][low_bits >> np.uint64(3)] >> (low_bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, cells = left[some], cells[some]
            at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
            left = left[known[at] == cells]
        return left


def distinct(edges: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Each document's different windows, one after the other."""
    return np.concatenate([np.zeros(0, np.uint64), *[np.unique(low[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]])


def pieces(low: np.ndarray, cell_bits: int, slice_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(slice, cells that are touched, those of them touched twice) of a partition's sketch."""
    inside = np.uint64(cell_bits - slice_bits)
    for row in range(ROWS):
        # Sorted in place: a sketch's arrays are most of what a task holds.
        cells = _cells(low, row, cell_bits)
        cells.sort()
        first = np.append(True, cells[1:] != cells[:-1])[: len(cells)]
        twice = np.append(~first[1:], False)[: len(cells)][first]
        cells = cells[first]
        edges = np.searchsorted(cells, np.arange((1 << slice_bits) + 1, dtype=np.uint64) << inside)
        cells &= np.uint64((1 << int(inside)) - 1)
        local = cells
        for s in range(1 << slice_bits):
            a, b = edges[s], edges[s + 1]
            if a < b:
                yield (row << slice_bits) + s, _pack(local[a:b]), _pack(local[a:b][twice[a:b]])


def merged(parts: list[tuple[int, bytes, bytes]], bits: int) -> Iterator[tuple[int, bytes]]:
    """(batch, its cells that count two or more) of the pieces (batch, once, twice) of one slice."""
    one, two = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
    for _, once, twice in parts:
        cells = _unpack(once)
        two[cells[one[cells]]] = True
        one[cells] = True
        if len(twice):
            two[_unpack(twice)] = True
    for batch, once, _ in parts:
        cells = _unpack(once)
        found = cells[two[cells]]
        if len(found):
            yield batch, _pack(found.astype(np.uint64))


def answers(dealt: DataFrame, size: int, cell_bits: int, slice_bits: int) -> DataFrame:
    """(batch, slice, cells): what the merged sketch says of every batch's own cells."""
    bits = cell_bits - slice_bits

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        batch, out, held = int(frame["batch"].iloc[0]), [], []
        # A batch may send several sketches, so that no more than one is held unpacked.
        for _, edges, low, _ in blocks(frame["text"], size):
            held.append(distinct(edges, low))
            if sum(map(len, held)) > PIECE:
                out += [(batch, *p) for p in pieces(np.concatenate(held), cell_bits, slice_bits)]
                held = []
        if held:
            out += [(batch, *p) for p in pieces(np.concatenate(held), cell_bits, slice_bits)]
        return pd.DataFrame(out, columns=["batch", "slice", "once", "twice"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Pieces come sorted by slice, so a task holds one slice, whatever it receives.
        number, parts = -1, []

        def done():
            out = [(batch, number, cells) for batch, cells in merged(parts, bits)]
            if out:
                yield pd.DataFrame(out, columns=["batch", "slice", "cells"])

        for frame in frames:
            for batch, own, once, twice in zip(frame["batch"], frame["slice"], frame["once"], frame["twice"], strict=True):
                if own != number:
                    yield from done()
                    number, parts = own, []
                parts.append((batch, once, twice))
        yield from done()

    sent = dealt.select("doc_id", "text", "batch").groupBy("batch").applyInPandas(count, "batch bigint, slice bigint, once binary, twice binary")
    sorted_ = sent.repartition("slice").sortWithinPartitions("slice")
    return sorted_.mapInPandas(merge, "batch bigint, slice bigint, cells binary")


def heard_by(frame: pd.DataFrame, cell_bits: int, slice_bits: int) -> Answers:
    """The answers (slice, cells) of a batch."""
    inside, out = np.uint64(cell_bits - slice_bits), {}
    for own, cells in zip(frame["slice"], frame["cells"], strict=True):
        row, s = divmod(int(own), 1 << slice_bits)
        out.setdefault(row, []).append(_unpack(cells).astype(np.uint64) + (np.uint64(s) << inside))
    return Answers({row: np.unique(np.concatenate(parts)) for row, parts in out.items()}, cell_bits)


def _keys(low: np.ndarray, high: np.ndarray):
    """The different windows of a batch in a fixed order, and each window's number among them."""
    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    number = np.empty(len(low), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[new], b[new], number


def deduplicate(docs: DataFrame, size: int = WINDOW, bits: tuple[int, int] | None = None, keep: tuple = ()) -> DataFrame:
    """Every document's kept words: doc_id, n_words, n_removed, kept, and the columns of ``keep``.

    ``bits``: those of the sketch's cells and slices, by default as the corpus asks for.
    """
    return _deduplicate(docs, size, bits, keep, "kept")


def digests(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``deduplicate`` with the kept words as a digest."""
    return _deduplicate(docs, size, None, (), "kept_sha256")


def _deduplicate(docs, size, bits, keep, result):
    """``result``: kept (words), kept_sha256, or text (the text itself where nothing goes)."""
    ship(docs.sparkSession)
    length = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    cell_bits, slice_bits = bits or sketch_bits(length)
    batches = max(1, -(-length // BATCH_BYTES))
    others = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    # Rows without doc_id are dealt by their text.
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), F.lit(7))
    dealt = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(LAST))).alias("doc_id"), "text", *others,
        F.pmod(place, F.lit(batches)).alias("batch"),
    )
    # Written: both later passes ask for them, and each is a row a slice.
    heard = stage(answers(dealt, size, cell_bits, slice_bits))
    tidy(docs.sparkSession)

    def flagged(frame: pd.DataFrame, said: pd.DataFrame):
        """A batch in order, its windows that may repeat (document, place, hashes) and their number among the different ones."""
        frame, known, parts = in_order(frame), heard_by(said, cell_bits, slice_bits), []
        for start, edges, low, high in blocks(frame["text"], size):
            at = known.repeated(low)
            document = np.searchsorted(edges, at, side="right") - 1
            parts.append((start + document, at - edges[document], low[at], high[at]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        document, place, low, high = (np.concatenate([p[k] for p in (empty, *parts)]) for k in range(4))
        return frame, frame["doc_id"].to_numpy(np.int64), document, place, *_keys(low, high)

    def ask(frame: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["low", "high", "place", "first"])
        batch = int(frame["batch"].iloc[0]) << 32
        _, ids, document, _, a, b, number = flagged(frame[["doc_id", "text"]], said)
        first = np.full(len(a), LAST)
        np.minimum.at(first, number, ids[document])
        # A window's place: its batch, and its number there. Both in one column, as rows are many.
        return pd.DataFrame({"low": a.view(np.int64), "high": b.view(np.int32), "place": batch + np.arange(len(a)), "first": first})

    asked = dealt.groupBy("batch").cogroup(heard.groupBy("batch")).applyInPandas(ask, "low bigint, high int, place bigint, first bigint")
    earlier = F.min("first").over(Window.partitionBy("low", "high"))
    found = asked.withColumn("earlier", earlier).where("earlier < first").select(
        F.shiftright("place", 32).alias("batch"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("idx"), "earlier"
    )
    # What a batch is told: the sketch's answers and the earlier documents of its windows.
    none = lambda kind: F.lit(None).cast(kind)
    told = heard.select("batch", "slice", "cells", none("bigint").alias("idx"), none("bigint").alias("earlier")).unionByName(
        found.select("batch", none("bigint").alias("slice"), none("binary").alias("cells"), "idx", "earlier")
    )

    def apply(frame: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=names)
        heard_ = said["cells"].notna()
        frame, ids, document, place, a, _, number = flagged(frame, said[heard_])
        first = np.full(len(a), LAST)
        np.minimum.at(first, number, ids[document])
        at = said["idx"][~heard_].to_numpy(np.float64).astype(np.int64)
        first[at] = np.minimum(first[at], said["earlier_"][~heard_].to_numpy(np.int64))
        gone = first[number] < ids[document]
        document, place = document[gone], place[gone]
        edges = np.searchsorted(document, np.arange(len(frame) + 1))
        out = []
        for i, text in enumerate(frame["text"]):
            w = words(text)
            starts = place[edges[i] : edges[i + 1]]
            covered = np.zeros(len(w) + 1, np.int64)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + size, -1)
            stay = np.cumsum(covered[:-1]) == 0
            kept = b" ".join([w[j] for j in np.flatnonzero(stay)] if len(starts) else w)
            if result == "kept_sha256":
                kept = hashlib.sha256(kept).hexdigest()
            else:
                kept = kept.decode("utf-8") if result == "kept" or len(starts) else frame["own"].iat[i]
            out.append((len(w), int((~stay).sum()), kept))
        done = pd.DataFrame(out, columns=names[1:4])
        done.insert(0, "doc_id", frame["doc_id"].values)
        for name in names[4:]:
            done[name] = frame[name].values
        return done

    names = ["doc_id", "n_words", "n_removed", result, *[f"kept_{i}" for i in range(len(keep))]]
    kinds = ["bigint", "bigint", "bigint", "string", *[docs.schema[c].dataType.simpleString() for c in keep]]
    # Earlier doc_ids are never null; where there is none 0 stands, or pandas would make floats of them all.
    told = told.withColumn("earlier_", F.coalesce("earlier", F.lit(0))).drop("earlier")
    done = (
        dealt.groupBy("batch").cogroup(told.groupBy("batch"))
        .applyInPandas(apply, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    )
    done = done.withColumn("doc_id", F.nullif("doc_id", F.lit(int(LAST))))
    return reading(done.select(*names[:4], *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]), heard)


def trimmed(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without repeated passages, columns and their order unchanged.

    A text that loses nothing stays as it is, line breaks included; of others the
    kept words are joined by one space and ``n_chars``, if there, follows.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    # The operator's own columns come first; further ones by place, as names may clash.
    found = _deduplicate(docs, size, None, others, "text")
    done = found.toDF("doc_id", "words_", "removed_", "text", *[f"own_{i}" for i in range(len(others))])
    place = {"doc_id": "doc_id", "text": "text", **{c: f"own_{i}" for i, c in enumerate(others)}}

    def column(c: str):
        own = F.col(place[c])
        if c == "n_chars":
            own = F.when(F.col("removed_") > 0, F.char_length("text")).otherwise(own)
        return own.cast(docs.schema[c].dataType).alias(c)

    return reading(done.select(*[column(c) for c in docs.columns]), *found.stages)
