"""Vector codes: parts of vectors as entries of codebooks learnt by Lloyd rounds over active entries.

Vectors become integers, floor(``SCALE`` * x), and are cut into ``PARTS`` equal parts.
Each part position has a codebook of up to ``ENTRIES`` integer entries. A round
assigns every part to its nearest entry and replaces each entry by the rounded-down
mean of its parts; all arithmetic is exact, so neither partitioning nor lost executors
change a digit.

A part keeps its entry and the exact squared distance to it. If that entry did not
move in the last replacement, the distance still holds and all other unmoved entries
are still no nearer, so only entries that moved are compared. If it moved, the part
scans the whole codebook. Ties go to the lower index in both cases: a moved entry
takes over only if it is nearer, or as near with a lower index.

A round is one pass: it reads vectors with their entries and distances from the last
written round, writes them anew, and in the same file, one row for each used entry of a
task, the sums of the parts. Spark adds these up (``ENTRIES`` * ``PARTS`` rows reach the
driver, a parameter whatever the table holds); the next codebook, as large, goes to the
tasks. The round before is then removed. Nothing is shuffled but those sums.

Defined cases: vectors that are null or hold null or non-finite components are
dropped; so are, coded as null, those whose length is not the table's (the most
frequent length that can be cut; of equally frequent ones the greatest): they come
back without code and error and take no part in codebooks or error sums. Fewer
vectors than entries give smaller codebooks; equal vec_ids are ordered by their
vectors, null vec_ids are last, and all equal rows are coded; null labels are one
label; a component beyond +-2**``MOST_BITS`` after scaling raises a ValueError, as its
distances would leave 64 bits; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import discard, ship, stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components up to which squared distances of parts of 2**8 components fit 64 bits.
MOST_BITS = 26
#: Parts that are compared with a codebook at once.
BLOCK = 4096


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; by way of doubles where every partial sum is exact in them."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every part to every entry."""
    square = lambda m: (m * m).sum(axis=1)
    return square(parts)[:, None] + square(entries)[None, :] - 2 * _product(parts, entries)


def scan(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part, ties to the lower index, and its distance."""
    near, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), BLOCK):
        all_ = distances(parts[at : at + BLOCK], entries)
        best = all_.argmin(axis=1)
        near[at : at + BLOCK] = best
        far[at : at + BLOCK] = all_[np.arange(len(best)), best]
    return near, far


def reassign(parts: np.ndarray, near: np.ndarray, far: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``scan`` by what the last round knew: entry and distance under the former codebook.

    ``moved``: which entries differ from the former codebook.
    """
    near, far = near.copy(), far.copy()
    active = moved[near]
    if active.any():
        near[active], far[active] = scan(parts[active], entries)
    fixed = np.flatnonzero(~active)
    numbers = np.flatnonzero(moved)
    if len(fixed) and len(numbers):
        best, gap = scan(parts[fixed], entries[numbers])
        best = numbers[best]
        closer = (gap < far[fixed]) | ((gap == far[fixed]) & (best < near[fixed]))
        near[fixed[closer]], far[fixed[closer]] = best[closer], gap[closer]
    return near, far


class Books:
    """The codebooks of all part positions, and which of their entries moved last."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries  # part, entry, position within the part
        self.moved = np.ones(entries.shape[:2], bool) if moved is None else moved

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """The next codebooks: means rounded down, unused entries as they are."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        return Books(entries, (entries != self.entries).any(axis=2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _round(vectors: DataFrame, books: Books, first: bool) -> DataFrame:
    """The rows with entries and distances under ``books``, and rows of sums, written."""
    parts, width = books.entries.shape[0], books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(books.entries.shape, np.int64)
        counts = np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = np.asarray(batch.column("vector").flatten(), np.int64).reshape(n, parts, width)
            if not first:
                near_ = np.asarray(batch.column("near").flatten(), np.int64).reshape(n, parts)
                far_ = np.asarray(batch.column("far").flatten(), np.int64).reshape(n, parts)
            near, far = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(flat[:, p])
                if first:
                    near[:, p], far[:, p] = scan(own, books.entries[p])
                else:
                    near[:, p], far[:, p] = reassign(own, near_[:, p], far_[:, p], books.entries[p], books.moved[p])
                np.add.at(sums[p], near[:, p], own)
                counts[p] += np.bincount(near[:, p], minlength=len(counts[p]))
            at = np.arange(0, n * parts + 1, parts, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(m.ravel(), t)) for m, t in ((near, pa.int32()), (far, pa.int64()))]
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
            held = [batch.column(c) for c in ("vec_id", "label", "vector")]
            yield pa.RecordBatch.from_arrays([*held, *lists, *none], names=NAMES)
        used = np.argwhere(counts > 0)
        if len(used):
            both = np.concatenate([sums[used[:, 0], used[:, 1]], counts[used[:, 0], used[:, 1], None]], axis=1)
            at = np.arange(0, both.size + 1, width + 1, dtype=np.int32)
            entry = pa.array((used[:, 0] * counts.shape[1] + used[:, 1]).astype(np.int32))
            empty = [pa.nulls(len(used), t) for t in kinds[:5]]
            yield pa.RecordBatch.from_arrays([*empty, entry, pa.ListArray.from_arrays(at, pa.array(both.ravel()))], names=NAMES)

    label = vectors.schema["label"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.int64(), to_arrow_type(label), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    schema = (
        f"vec_id bigint, label {label.simpleString()}, vector array<int>, near array<int>, far array<bigint>, "
        "entry int, sums array<bigint>"
    )
    return stage(vectors.mapInArrow(run, schema))


NAMES = ["vec_id", "label", "vector", "near", "far", "entry", "sums"]


def _totals(done: DataFrame, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every entry over all tasks."""
    parts, entries, width = books.entries.shape
    sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64)
    pieces = done.where(F.col("entry").isNotNull()).select("entry", F.posexplode("sums").alias("at", "n"))
    for r in pieces.groupBy("entry", "at").agg(F.sum("n").alias("n")).collect():
        p, e = divmod(r.entry, entries)
        if r["at"] < width:
            sums[p, e, r["at"]] = r.n
        else:
            counts[p, e] = r.n
    return sums, counts


def integers(rows: DataFrame, vector: str, scale: int = SCALE):
    """The vector's components as integers, null if any of them is none."""
    own = F.col(vector)
    finite = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(own, lambda x: F.floor(x.cast("double") * scale)))


def compress(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """Every kept row as (vec_id, label, near, far) and the final codebooks.

    ``near``: its entries in part order, null for vectors of another length; ``far``:
    their exact squared distances.
    """
    spark = rows.sparkSession
    ship(spark)
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label, integers(rows, vector).alias("v")).where(F.col("v").isNotNull())
    most = F.array_max(F.transform("v", F.abs))
    lengths = kept.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(most).alias("most")).collect()
    cut = [(r.rows, r.n) for r in lengths if r.n and r.n % parts == 0]
    length = max(cut)[1] if cut else parts
    if any((r.most or 0) > 2**MOST_BITS for r in lengths):
        raise ValueError(f"a component exceeds 2**{MOST_BITS} after scaling")
    fitting = kept.where(F.size("v") == length).select("vec_id", "label", F.col("v").cast("array<int>").alias("vector"))
    # The first rows by vec_id, with a limit of as many as a codebook has entries.
    first = fitting.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    start = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, length // parts)
    books = Books(np.ascontiguousarray(start.transpose(1, 0, 2)))
    others = kept.where(F.size("v") != length).select("vec_id", "label", F.lit(None).cast("array<int>").alias("near"), F.lit(None).cast("array<bigint>").alias("far"))
    if not first:
        empty = others if lengths else others.limit(0)
        return empty, books
    done = _round(fitting, books, True)
    for _ in range(rounds):
        books = books.replaced(*_totals(done, books))
        before = done
        done = _round(before.where(F.col("entry").isNull()).select(*NAMES[:5]), books, False)
        discard(before)
    coded = done.where(F.col("entry").isNull()).select("vec_id", "label", "near", "far")
    return coded.unionByName(others), books


def codes(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    done, books = compress(rows, vector)
    pairs = F.transform("near", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    error = F.aggregate("far", F.lit(0).cast("bigint"), lambda a, x: a + x)
    coded = done.select("vec_id", F.struct("label").alias("label"), F.concat_ws("", pairs).alias("hex_"), error.alias("error"))
    coded = coded.withColumn("code", F.when(F.col("error").isNotNull(), F.col("hex_"))).drop("hex_")
    # The struct makes null labels equal. Sums are added map-side; AQE splits a label with many rows.
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    return coded.join(sums, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
