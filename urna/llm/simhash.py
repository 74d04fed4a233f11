"""SimHash near-duplicates over a forest of vantage points.

A text's fingerprint has a bit set where more than half of its shingles' XXH64
values have it. Fingerprints that differ in at most ``RADIUS`` bits are linked;
a class is what is reachable over links.

Exact search: a small tree of vantage points, fitted on a bounded sample of the
fingerprints, cuts Hamming space into shards. Every distinct fingerprint lives
in one shard (points) and also visits, as a query, each further shard that the
triangle bound does not rule out: with d its distance from a vantage point and m
the cut, the inner side can hold a match only if d - RADIUS <= m, the outer one
only if d + RADIUS > m. Inside a shard the same rule prunes a local tree down to
small blocks that are compared by popcount. So no pair within the radius is lost
and none beyond it is linked.

A shard reports a spanning star for each class it sees, not its pairs: a group of
n near copies gives n rows a shard. Shards are joined by passing the smallest
doc_id between classes and members until nothing changes, every round written to
the shared folder.

Defined cases: texts without words (null, empty, blanks) have fingerprint 0 and
are linked like any other; fewer words than a shingle make one shingle of them
all; equal texts share a fingerprint and so a class; repeated rows come back as
often as they came; null doc_ids get a component only if a non-null one is
reachable; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from urna.llm.common import components, discard, reading, split_words, stage

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints the upper tree is fitted on, and distinct ones it aims at in a shard.
SAMPLE, SHARD_POINTS = 8192, 32_768
#: Deepest upper tree: its table, which travels with the tasks, stays below 2**MAX_DEPTH rows.
MAX_DEPTH = 20
#: Points of a block that is compared whole.
BLOCK = 192


def shingle_hashes(text, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    word = split_words(text)
    if not word:
        return np.zeros(0, np.uint64)
    if len(word) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(word), SEED)], np.uint64)
    ends = np.fromiter(map(len, word), np.int64, len(word)) + 1
    ends = np.cumsum(ends) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, digest = b" ".join(word), xxhash.xxh64_intdigest
    spans = zip(starts[: len(word) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(word) - size + 1)


def fingerprint(text, size: int = SHINGLE) -> int:
    """The majority bits of a text's shingles as a signed 64-bit number."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 1 << 16):
        part = h[start : start + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h))
    return int(bits.view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed 64-bit number."""

    @F.pandas_udf("bigint")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    # Ids stay in Spark: beside a null, pandas would make floats of them.
    return docs.select("doc_id", own("text").alias("fp"))


class Tree:
    """The upper tree: vantage points and cuts of a complete binary tree."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.vantage = np.zeros(2**depth, np.uint64)
        self.cut = np.zeros(2**depth, np.int64)
        random = np.random.default_rng(7)
        parts = {1: sample}
        for node in range(1, 2**depth):
            own = parts.pop(node)
            own = own if len(own) else sample
            v = own[random.integers(len(own))]
            d = np.bitwise_count(own ^ v)
            self.vantage[node], self.cut[node] = v, int(np.median(d))
            inner = d <= self.cut[node]
            parts[2 * node], parts[2 * node + 1] = own[inner], own[~inner]

    def route(self, fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, row numbers, whether the row lives there) for each shard reached."""
        todo = [(1, np.arange(len(fp)), np.ones(len(fp), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node >= 2**self.depth:
                yield node - 2**self.depth, rows, home
                continue
            d = np.bitwise_count(fp[rows] ^ self.vantage[node]).astype(np.int64)
            m = self.cut[node]
            left, right = d - radius <= m, d + radius > m
            todo.append((2 * node, rows[left], (home & (d <= m))[left]))
            todo.append((2 * node + 1, rows[right], (home & (d > m))[right]))


def linked(fp: np.ndarray, points: np.ndarray, radius: int) -> np.ndarray:
    """Smallest index of each row's class among links between rows and ``points``.

    ``fp``: a shard's distinct fingerprints; ``points``: numbers of those that live there.
    """
    random = np.random.default_rng(11)
    label, held, size = np.arange(len(fp)), [], 0
    todo = [(np.arange(len(fp)), points)]

    def fold():
        nonlocal label, held, size
        if held:
            # The links so far stay as a star: a row and its class.
            a = np.concatenate([x for x, _ in held] + [np.arange(len(fp))])
            b = np.concatenate([y for _, y in held] + [label])
            label, held, size = components(len(fp), a, b), [], 0

    while todo:
        queries, own = todo.pop()
        if not len(queries) or not len(own):
            continue
        if len(own) <= BLOCK or len(queries) <= 8:
            for start in range(0, len(queries), 4096):
                q = queries[start : start + 4096]
                near = np.bitwise_count(fp[q][:, None] ^ fp[own][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b = q[a], own[b]
                other = label[a] != label[b]
                if other.any():
                    held.append((a[other], b[other]))
                    size += int(other.sum())
                    if size > 200_000:
                        fold()
            continue
        v = fp[own[random.integers(len(own))]]
        d, dq = np.bitwise_count(fp[own] ^ v).astype(np.int64), np.bitwise_count(fp[queries] ^ v).astype(np.int64)
        m = int(np.median(d))
        if (d <= m).all():  # all as near as the median: cut just below
            m = int(d.max()) - 1
            if (d > m).all():
                for start in range(0, len(own), BLOCK):
                    todo.append((queries, own[start : start + BLOCK]))
                continue
        todo.append((queries[dq - radius <= m], own[d <= m]))
        todo.append((queries[dq + radius > m], own[d > m]))
    fold()
    return label


def shard_stars(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, star): every fingerprint that has links, with the classes of the shards it visits.

    A star's number is a hash of the shard and its smallest member there.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, count / SHARD_POINTS))))))
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"]
    tree = Tree(np.sort(sample.to_numpy(np.int64).view(np.uint64)), depth) if count else None
    if tree is None:
        return spark.createDataFrame([], "fp bigint, star bigint")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp, out = frame["fp"].to_numpy(np.int64).view(np.uint64), []
            for shard, rows, home in tree.route(fp, radius):
                # Eight bytes a fingerprint, not a row.
                out.append((shard, fp[rows[home]].tobytes(), fp[rows[~home]].tobytes()))
            yield pd.DataFrame(out, columns=["shard", "points", "visitors"])

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        points, visitors = (np.frombuffer(b"".join(frame[c]), np.uint64) for c in ("points", "visitors"))
        # In one order, whatever order the rows came in: numbers as they are stored, negative ones first.
        fp, home = np.concatenate([points, visitors]), np.arange(len(points) + len(visitors)) < len(points)
        order = np.argsort(fp.view(np.int64), kind="stable")
        fp, home = fp[order], home[order]
        label = linked(fp, np.flatnonzero(home), radius)
        members = np.bincount(label, minlength=len(fp))[label] > 1
        star = [xxhash.xxh64_intdigest(f"{frame['shard'].iloc[0]}:{x}") for x in fp[label[members]]]
        return pd.DataFrame({"fp": fp[members].view(np.int64), "star": np.array(star, np.uint64).view(np.int64)})

    routed = nodes.select("fp").mapInPandas(route, "shard bigint, points binary, visitors binary")
    return routed.groupBy("shard").applyInPandas(search, "fp bigint, star bigint")


def settle(stars: DataFrame, label: DataFrame) -> DataFrame:
    """(fp, component): the smallest label reachable over the stars, both written tables; ``label`` is removed."""
    while True:
        # Both joins read written tables on both sides, so a large class is a
        # skewed join that can be split; the sums combine before their shuffle.
        low = stage(
            stars.join(label, "fp").groupBy("star").agg(F.min("component").alias("low"))
        )
        new = stage(
            stars.join(low, "star").groupBy("fp").agg(F.min("low").alias("component"))
        )
        settled = new.join(label.withColumnRenamed("component", "was"), "fp").where(
            ~F.col("component").eqNullSafe(F.col("was"))
        ).isEmpty()
        discard(low, label)
        label = new
        if settled:
            return label


def classes(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): the smallest ``first`` reachable from each distinct fingerprint."""
    nodes = stage(nodes)
    stars = stage(shard_stars(nodes, radius))
    if stars.isEmpty():
        return nodes.select("fp", F.col("first").alias("component"))
    label = settle(stars, stage(nodes.join(stars.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("first").alias("component"))))
    found = label.withColumnRenamed("component", "found")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("found", "first").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = stage(fingerprints(docs, size))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = stage(classes(nodes, radius))
    return prints.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_each(rows: DataFrame, label: DataFrame, node: str) -> DataFrame:
    """Of each class the rows with its smallest doc_id, or one row where none has a doc_id.

    ``rows``: a written table with a column ``node``; ``label``: (fp, component) of its linked nodes.
    """
    label = label.select(F.col("fp").alias(node), F.col("component").alias("_component"))
    nodes = rows.groupBy(node).agg(F.min("doc_id").alias("first")).join(label, node, "left").withColumn("_component", F.coalesce("_component", node))
    groups = stage(nodes.groupBy("_component").agg(F.min("first").alias("first"), F.min(node).alias(node)))
    kept = rows.join(groups.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    nameless = rows.where(F.col("doc_id").isNull()).join(groups.where(F.col("first").isNull()), node, "left_semi")
    return reading(kept.unionByName(nameless.dropDuplicates([node])), groups)


def representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each class the rows with its smallest doc_id, or one row where none has a doc_id; columns unchanged.

    Rows that share a doc_id are one document and all stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*batch.schema.names, "_fp"])

    rows = stage(docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("_fp", LongType())))
    nodes = rows.select(F.col("_fp").alias("fp"), F.col("_fp").alias("first")).distinct()
    kept = one_each(rows, classes(nodes, radius), "_fp")
    return reading(kept.select(*docs.columns), rows, *kept.stages)
