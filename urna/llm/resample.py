"""Importance resampling towards a target distribution of hashed word n-grams.

A text's features are its runs of one to three words; a feature's bucket is the
CRC-32 of its bytes, reduced. A bucket's gain compares its share in the target with
its share in the corpus; a document's weight is the sum of its features' gains.

1. Every task counts the buckets of its texts into one array and sends the buckets it
   has; Spark adds them up. The table of gains has ``BUCKETS`` numbers, whatever the
   corpus holds, and goes to the tasks.
2. A second pass scores every document: CRCs of word runs are put together from those
   of single words by arrays (a CRC of a joined string is a linear step of the first
   part's, exclusive-or the second's), and gains are gathered and added by arrays. A
   noise from the digest of the doc_id makes the highest scores a draw without
   replacement. Scores are written once.
3. The cutoff is found by bisection on numbers: each exact count job over the written
   scores counts at ``CUTS`` cutoffs at once, first on the score, then on the doc_id
   among rows of the cutoff's score.
4. Rows from the cutoff on are range-partitioned and sorted; a rank is the place in the
   written range plus all earlier ranges. Rows that share score and doc_id are ordered
   by their place in the written scores, so that even a third of all rows being one
   row splits into ranges, and exactly the asked number is drawn.

Defined cases: null and empty texts have no features, weight 0 and are never drawn; a
null doc_id draws its noise from an empty id and is after all others in a tie; equal
rows are drawn one by one, each with its own rank; an empty corpus or target counts
as having no features; fewer documents than needed for one draw draw none; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna.llm.common import ship, stage

BUCKETS, LONGEST_RUN, SEED = 10_000, 3, 42
#: Words a document needs to be drawn, and per cent of such documents that are.
LEAST_WORDS, PER_CENT = 20, 5
#: Cutoffs that one count job tries.
CUTS = 63
#: Words of a text that are scored at once.
BLOCK = 1 << 18
#: A doc_id after all others, for null.
LAST = 2**63 - 1

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _zeros(length: int) -> np.ndarray:
    """Byte tables (4 x 256) of what appending ``length`` zero bytes does to a CRC without its masks."""
    basis = []
    for bit in range(32):
        # zlib masks its state on the way in and out; both sides use the same masks.
        basis.append(zlib.crc32(b"\0" * length, (1 << bit) ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0" * length, 0xFFFFFFFF))
    table = np.zeros((4, 256), np.uint32)
    for plane in range(4):
        for value in range(1, 256):
            low = value & -value
            table[plane, value] = table[plane, value ^ low] ^ basis[8 * plane + low.bit_length() - 1]
    return table


class Shifts:
    """``crc(a + b)`` is ``after(crc(a), len(b)) ^ crc(b)``; tables by length, as they are met."""

    def __init__(self, known: int = 64):
        self.tables = np.stack([_zeros(n) for n in range(known)])

    def after(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(crc), np.uint32)
        short = length < len(self.tables)
        a, n = crc[short], length[short]
        out[short] = (
            self.tables[n, 0, a & 255] ^ self.tables[n, 1, (a >> 8) & 255]
            ^ self.tables[n, 2, (a >> 16) & 255] ^ self.tables[n, 3, a >> 24]
        )
        # Words of 64 bytes and more are rare and long: a pass over them costs what they cost anyway.
        for i in np.flatnonzero(~short):
            zero = b"\0" * int(length[i])
            out[i] = zlib.crc32(zero, int(crc[i]) ^ 0xFFFFFFFF) ^ zlib.crc32(zero, 0xFFFFFFFF)
        return out


_SHIFTS: list[Shifts] = []


def shifts() -> Shifts:
    if not _SHIFTS:
        _SHIFTS.append(Shifts())
    return _SHIFTS[0]


def words_of(text) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return _WORD.findall(text.encode("utf-8").lower()) if isinstance(text, str) else []


def run_buckets(own: list[bytes], longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of one to ``longest`` words, block by block."""
    step = shifts()
    for start in range(0, len(own), BLOCK):
        # A block reads over its end, so that runs across it are complete.
        here = own[start : start + BLOCK + longest - 1]
        crc = np.fromiter(map(zlib.crc32, here), np.uint32, len(here))
        length = np.fromiter(map(len, here), np.int64, len(here))
        # The word with its blank in front.
        blank = np.full(len(here), zlib.crc32(b" "), np.uint32)
        spaced = step.after(blank, length) ^ crc
        run = crc
        yield (run[:BLOCK] % np.uint32(buckets)).astype(np.int64)
        for k in range(1, longest):
            if len(here) <= k:
                break
            run = step.after(run[:-1], length[k:] + 1) ^ spaced[k:]
            yield (run[:BLOCK] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; at most ``buckets`` rows a task, and as many reach the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(buckets, np.int64)
        for frame in frames:
            for text in frame["text"]:
                for at in run_buckets(words_of(text), buckets=buckets):
                    held += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": held[at]})

    out = np.zeros(buckets, np.int64)
    counted = texts.select("text").mapInPandas(count, "bucket int, n bigint")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (float(t) + 1) * (all_corpus + n) / ((float(s) + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: str, seed: int = SEED) -> int:
    """Thousandths of a Gumbel value drawn by the digest of seed and doc_id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    ship(docs.sparkSession)
    table = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint, noise bigint")
    def score(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in columns:
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                own, features, weight = words_of(text), 0, 0
                for at in run_buckets(own, buckets=buckets):
                    features += len(at)
                    weight += int(table[at].sum())
                out.append((len(own), features, weight, noise(doc_id, seed)))
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight", "noise"])

    # Ids go as text: a null among them would make them floats.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", score(key, F.col("text")).alias("s"))
    return rows.select("doc_id", "s.n_words", "s.n_features", "s.weight", (F.col("s.weight") + F.col("s.noise")).alias("score"))


def least_with(rows: DataFrame, column: Column, wanted: int, low: int, high: int, cuts: int = CUTS) -> tuple[int, int]:
    """The smallest cutoff in low..high that at most ``wanted`` values exceed, and how many do.

    Each job counts exactly at up to ``cuts`` cutoffs of what is left of the range;
    nothing exceeds ``high``.
    """
    above = 0
    while low < high:
        width = high - low
        tried = sorted({low + width * i // (cuts + 1) for i in range(1, cuts + 1)} | {low})
        asked = [F.count(F.when(column > c, 1)).alias(f"c{i}") for i, c in enumerate(tried)]
        counts = list(rows.agg(*asked).first())
        fits = [i for i, n in enumerate(counts) if n <= wanted]
        if fits:
            high, above = tried[fits[0]], counts[fits[0]]
            low = tried[fits[0] - 1] + 1 if fits[0] else high
        else:
            low = tried[-1] + 1
    return high, above


def draw(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank 1 is drawn first, null is not drawn."""
    rows = stage(scored(docs, target, seed).withColumn("place_", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words)
    n, low, high = able.agg(F.count("*"), F.min("score"), F.max("score")).first()
    wanted = n * per_cent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return rows.select(*names, undrawn)

    # Highest scores: those above the cutoff all, of the cutoff's own as many as are left by doc_id.
    cut, above = least_with(able, F.col("score"), wanted, low - 1, high)
    tied, number = able.where(F.col("score") == cut), F.coalesce(F.col("doc_id"), F.lit(LAST))
    left = wanted - above
    if left:
        # The smallest doc_id cutoff with enough rows up to it is the smallest that few enough exceed.
        size, first, last = tied.agg(F.count("*"), F.min(number), F.max(number)).first()
        last_id, _ = least_with(tied, number, size - left, first, last)
        inside = (F.col("score") > cut) | ((F.col("score") == cut) & (number <= last_id))
    else:
        inside = F.col("score") > cut
    inside = F.col("n_words").isNotNull() & (F.col("n_words") >= least_words) & inside

    order = [F.desc("score"), F.asc("number_"), F.asc("place_")]
    ranges = rows.where(inside).withColumn("number_", number).repartitionByRange(*order).sortWithinPartitions(*order)
    chosen = stage(ranges.select(*names, F.monotonically_increasing_id().alias("at_")))
    part, at = F.shiftright("at_", 33), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in chosen.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    # One row a range, at most as many as there are shuffle partitions.
    starts = docs.sparkSession.createDataFrame(offsets, "part_ bigint, before_ bigint")
    rank = F.col("before_") + at + 1
    ranked = chosen.withColumn("part_", part).join(F.broadcast(starts), "part_").select(
        *names, F.when(rank <= wanted, rank).alias("rank")
    )
    return ranked.unionByName(rows.where(~inside).select(*names, undrawn))
