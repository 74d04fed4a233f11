"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one and dealt to the nearest of some centroids, which
are fitted on a bounded sample; every vector is indexed. What a vector adds to its
centroid is rotated by a random orthogonal matrix and kept as one sign bit a
dimension, with three scalars: its length, its product with the centroid, and how
well the signs point along it. A query visits its nearest cells. There packed bits
and scalars give an estimate of every inner product together with an error bound.
The k best estimates of those a query meets are compared exactly, on the original
vectors in double precision; a vector is out if its upper bound lies below the least
of these k. The others are compared exactly too, and the k nearest of each bundle
are handed on, so what leaves a task is k rows a query.

Codes travel with their vectors, dealt into bundles of about ``CHUNK``: neighbouring
cells share one, a large cell (a vector that a third of the rows share) has several.
Queries come in blocks of about ``BLOCK``, so no task holds more than a bundle and a
block. A bundle is sent once a block and looked at by every query that visits its
cells: work grows with the square of the table, as one vector in ``EVERY`` asks. To
send codes alone and fetch vectors for what the bounds leave is dearer: where vectors
have little structure, that is a fixed share of all pairs.

Defined cases: vectors that are null, zero, of another dimension than most, or hold
null or non-finite components take no part, as candidate or query; a null vec_id
neither; equal scores go by vec_id; rows that share a vec_id are candidates each,
never of their own vec_id, and one query (of the smallest vector in order); with
fewer candidates than k all are returned; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urna.llm.common import discard, mix, ship, stage

#: Every vec_id divisible by this asks.
EVERY, K = 50, 5
#: Vectors the centroids are fitted on; vectors for one centroid; most centroids.
SAMPLE, PER_CELL, MOST_CELLS = 16_384, 400, 4096
#: Share of the cells that a query visits, and the fewest.
SHARE, FEWEST = 0.7, 12
CHUNK, BLOCK = 8192, 4096
#: Width of the error bound, in its standard deviations.
EPSILON = 2.2
#: Pairs that are compared exactly at a time.
PAIRS = 1 << 14


def _unit(frame: pd.Series) -> np.ndarray:
    own = np.stack([np.asarray(v, np.float64) for v in frame]) if len(frame) else np.zeros((0, 1))
    return own / np.sqrt((own * own).sum(axis=1))[:, None] if len(own) else own


def cosines(vectors: np.ndarray, queries: np.ndarray, vector: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The exact measure of pairs, given by the numbers of their rows."""
    size = lambda m: np.sqrt((m * m).sum(axis=1))
    out = np.empty(len(vector))
    for at in range(0, len(vector), PAIRS):
        x, y = vectors[vector[at : at + PAIRS]].astype(np.float64), queries[query[at : at + PAIRS]]
        out[at : at + PAIRS] = (x * y).sum(axis=1) / (size(x) * size(y))
    return out


class Index:
    """Centroids and the rotation; small, and sent to every task."""

    def __init__(self, sample: np.ndarray, cells: int):
        random = np.random.default_rng(41)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(random.standard_normal((d, d)))[0]
        centroids = sample[random.choice(len(sample), min(cells, len(sample)), replace=False)]
        for _ in range(10):
            near = (sample @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, sample)
            size = np.sqrt((sums * sums).sum(axis=1))
            centroids = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centroids)
        self.centroids = centroids
        self.probes = min(len(centroids), max(FEWEST, int(np.ceil(SHARE * len(centroids)))))

    def cell(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centroids.T).argmax(axis=1)

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """Nearest cells of each query."""
        return np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    def encode(self, unit: np.ndarray, cell: np.ndarray):
        """Packed signs and (length, product with the centroid, alignment) of each vector."""
        centre = self.centroids[cell]
        rest = unit - centre
        length = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.maximum(length, 1e-300)[:, None]) @ self.rotation.T
        align = np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])
        return np.packbits(turned > 0, axis=1), length, (rest * centre).sum(axis=1), align

    def estimate(self, codes: np.ndarray, scalars, cell: int, query: np.ndarray):
        """Estimated cosines (vectors x queries) and their error bounds."""
        d = self.centroids.shape[1]
        length, product, align = (x[:, None] for x in scalars)
        centre = self.centroids[cell]
        rest = query - centre
        turned = rest @ self.rotation.T
        signs = np.unpackbits(codes, axis=1, count=d).astype(np.float64) * 2 - 1
        along = signs @ turned.T / np.sqrt(d) / np.maximum(align, 1e-9)
        size = np.sqrt((rest * rest).sum(axis=1))[None, :]
        error = length * size * np.sqrt(np.maximum(1 - align**2, 0)) / np.maximum(align, 1e-9) * EPSILON / np.sqrt(max(1, d - 1))
        return (query @ centre)[None, :] + product + length * along, error + 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, embedding) of the rows that take part, written; ``uid`` tells rows of one vec_id apart."""
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = good.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return stage(good.where(F.size("embedding") == (sizes.d if sizes else -1)).withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "embedding"))


class Layout:
    """Which bundle holds a cell's vectors: neighbouring small cells share one, a large cell has several.

    A bundle has about ``CHUNK`` vectors, so a query travels once for that many.
    """

    def __init__(self, counts: dict[int, int], cells: int):
        self.first, self.number = np.zeros(cells, np.int64), np.ones(cells, np.int64)
        self.bundles, filled = 0, 0
        for cell in range(cells):
            n = counts.get(cell, 0)
            if n > CHUNK:
                if filled:
                    self.bundles, filled = self.bundles + 1, 0
                self.number[cell] = -(-n // CHUNK)
                self.first[cell] = self.bundles
                self.bundles += int(self.number[cell])
            else:
                if filled + n > CHUNK:
                    self.bundles, filled = self.bundles + 1, 0
                self.first[cell], filled = self.bundles, filled + n
        self.bundles += filled > 0

    def of_cells(self, visited: np.ndarray) -> np.ndarray:
        """Bundles that hold any of the cells."""
        return np.unique(np.concatenate([np.arange(f, f + n) for f, n in zip(self.first[visited], self.number[visited], strict=True)]))


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    count = rows.count()
    if not count:
        empty = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    index = Index(_unit(sample), max(1, min(MOST_CELLS, count // PER_CELL)))
    shared = spark.sparkContext.broadcast(index)
    # Single components travel as such; their doubles are the same numbers.
    width = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            unit = _unit(frame["embedding"])
            cell = shared.value.cell(unit)
            own = [np.asarray(v, width).tobytes() for v in frame["embedding"]]
            codes, length, product, align = shared.value.encode(unit, cell)
            yield frame.drop(columns="embedding").assign(cell=cell, code=[c.tobytes() for c in codes], length=length, product=product, align=align, vector=own)

    kinds = "uid bigint, vec_id bigint, cell int, code binary, length double, product double, align double, vector binary"
    indexed = stage(rows.mapInPandas(encode, kinds))
    # One row a cell, MOST_CELLS at most.
    layout = Layout({r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}, len(index.centroids))
    spread = spark.sparkContext.broadcast(layout)

    asking = stage(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    blocks = max(1, -(-asking.count() // BLOCK))
    discard(rows)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            for query_id, query, cells in zip(frame["vec_id"], frame["embedding"], shared.value.visits(_unit(frame["embedding"])), strict=True):
                bundles = spread.value.of_cells(cells)
                yield pd.DataFrame({"query_id": query_id, "bundle": bundles, "query": [query] * len(bundles)})

    visits = asking.mapInPandas(visit, "query_id bigint, bundle bigint, query array<double>").withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    )

    @F.pandas_udf("bigint")
    def bundle_of(cell: pd.Series, uid: pd.Series) -> pd.Series:
        own = cell.to_numpy(np.int64)
        return pd.Series(spread.value.first[own] + mix(uid.to_numpy(np.int64).view(np.uint64)).astype(np.uint64) % spread.value.number[own].astype(np.uint64))

    held = indexed.withColumn("bundle", bundle_of("cell", "uid")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def near(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Each query's k nearest of this bundle: by the bounds first, then exactly."""
        if not len(own) or not len(asked):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        own = own.sort_values(["cell", "uid"], kind="stable")
        ids, cells = (own[c].to_numpy(np.int64) for c in ("vec_id", "cell"))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in own["code"]])
        vectors = np.stack([np.frombuffer(v, width) for v in own["vector"]])
        scalars = [own[c].to_numpy(np.float64) for c in ("length", "product", "align")]
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        out = []
        for start in range(0, len(asked), 128):
            part = asked.iloc[start : start + 128]
            unit, asker = _unit(part["query"]), part["query_id"].to_numpy(np.int64)
            queries = np.stack([np.asarray(q, np.float64) for q in part["query"]])
            visited = shared.value.visits(unit)
            likely, high = np.full((len(own), len(part)), -np.inf), np.full((len(own), len(part)), -np.inf)
            for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
                there = np.flatnonzero((visited == cells[a]).any(axis=1))
                if len(there):
                    guess, error = shared.value.estimate(codes[a:b], [x[a:b] for x in scalars], int(cells[a]), unit[there])
                    likely[a:b, there], high[a:b, there] = guess, guess + error
            other = ids[:, None] != asker[None, :]
            likely, high = np.where(other, likely, -np.inf), np.where(other, high, -np.inf)
            compared = high > -np.inf
            if len(own) > k:
                first = np.argpartition(-likely, k - 1, axis=0)[:k]
                columns = np.broadcast_to(np.arange(len(part)), first.shape)
                best = cosines(vectors, queries, first.ravel(), columns.ravel()).reshape(first.shape)
                # With fewer than k candidates nothing is out.
                bar = np.where(compared[first, columns].all(axis=0), best.min(axis=0), -np.inf)
                met = np.zeros_like(compared)
                met[first, columns] = True
                compared &= met | (high >= bar[None, :])
            vector, query = np.nonzero(compared)
            score = cosines(vectors, queries, vector, query)
            order = np.lexsort((ids[vector], -score, query))
            vector, query, score = vector[order], query[order], score[order]
            near_ = np.arange(len(query)) - np.searchsorted(query, query) < k
            out.append(pd.DataFrame({"query_id": asker[query[near_]], "vec_id": ids[vector[near_]], "score": score[near_]}))
        return pd.concat(out)

    keys = ["bundle", "block"]
    found = stage(held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(near, "query_id bigint, vec_id bigint, score double"))
    discard(indexed, asking)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
