"""Quality classifier: logistic regression over hashed word n-grams, learnt by
follow-the-regularised-leader, scored as sparse dot products.

Features of a text are its words (A-Z in lower case), pairs of neighbouring
words, and one to three neighbouring word shapes (runs of letters, capitals and
digits reduced to a sign each, other bytes kept), all hashed into one table of
weights. A feature's value is its share of the text's n-grams of that kind, so
texts of any length weigh alike.

Learning sees a bounded sample of labelled rows: the ``sample`` rows with the
smallest hash of doc_id, dealt to ``SHARDS`` learners that each run the online
updates over their rows; the learners' weights are averaged. Scoring reads every
whole text once, without a shuffle. The weights are a table of fixed size.

Defined cases: null and empty texts have only the bias; repeated rows are scored
each; without any usable label every text scores 0.5; rows with a null label or
doc_id are not learnt from (a null doc_id is not held out and is scored); extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import as_bytes, crc_mod, let_go, mix

BITS, SHARDS, EPOCHS = 18, 6, 3
#: Most labelled rows that are learnt from.
SAMPLE = 24_000
#: Learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: A text's features of one kind sum to this.
SCALE = 12.0
#: Scores from here on are of label 1.
THRESHOLD = 0.3

_SHAPE = bytes(
    ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b
    for b in range(256)
)
_RUNS = re.compile(rb"([aA0])\1+")


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def features(text, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's n-grams (repeats included) and the value each adds there."""
    raw = as_bytes(text)
    word = _hashes(raw.lower().split())
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0)
    shape = _hashes(_RUNS.sub(rb"\1", raw.translate(_SHAPE)).split())
    kinds = [word, shape]
    for source, sizes in ((word, (2,)), (shape, (2, 3))):
        for n in sizes:
            if len(source) >= n:
                gram = np.zeros(len(source) - n + 1, np.uint64)
                for i in range(n):
                    gram = gram * np.uint64(0x9E3779B97F4A7C15) + source[i : len(source) - n + 1 + i]
                kinds.append(gram + np.uint64(n))
    shift = np.uint64(64 - bits)
    slots = [(mix(k ^ np.uint64(0x5851F42D4C957F2D * (i + 1) % 2**64)) >> shift).astype(np.int64) for i, k in enumerate(kinds)]
    return np.concatenate(slots), np.concatenate([np.full(len(s), SCALE / len(s)) for s in slots])


def _learn(frame: pd.DataFrame, bits: int) -> np.ndarray:
    """Weights, the bias last, after the online updates over the rows of a frame."""
    let_go()
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    frame = frame.sort_values(["rank", "doc_id"])
    rows = []
    for text, label in zip(frame["text"], frame["label"], strict=True):
        slots, values = features(text, bits)
        used, place = np.unique(slots, return_inverse=True)
        x = np.bincount(place, values, len(used)) if len(used) else np.zeros(0)
        rows.append((np.append(used, size - 1), np.append(x, 1.0).astype(np.float32), float(label)))

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, label in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights learnt from the labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("rank", F.xxhash64("doc_id"))
        .orderBy("rank", "doc_id").limit(sample)
    )
    # At most ``sample`` rows of three numbers: a proven bound for the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        w = _learn(frame, bits).astype(np.float32)
        return pd.DataFrame({"weights": [w.tobytes()], "n": [len(frame)]})

    learnt = (
        rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SHARDS)))
        .groupBy("shard").applyInPandas(learn, "weights binary, n bigint").collect()
    )
    total = sum(r.n for r in learnt)
    out = np.zeros((1 << bits) + 1)
    for r in learnt:
        out += np.frombuffer(r.weights, np.float32) * (r.n / total)
    return out.astype(np.float32)


def _scores(texts, weights: np.ndarray) -> np.ndarray:
    """Sparse dot products of whole texts with the weights, as probabilities."""
    let_go()
    bits = (len(weights) - 1).bit_length() - 1
    total = np.full(len(texts), weights[-1], dtype=np.float64)
    for i, text in enumerate(texts):
        slots, values = features(text, bits)
        total[i] += (weights[slots] * values).sum()
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(texts, shared.value))

    # Ids stay in Spark: beside a null, pandas would make floats of them.
    scored = docs.select("doc_id", own("text").alias("score"))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(texts, shared.value) >= threshold)

    return docs.where(good("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels and score every document."""
    return score(docs, fit(docs, labels))
