"""Sharding by longest-processing-time scheduling.

Documents with equal texts are a group and stay together. Groups go, largest first,
each to the least loaded shard (ties to the smaller number). That order depends on
sizes alone, so the schedule is worked out over classes of groups of one size: a
heap of shard loads deals a class's few groups one by one, and a class of many is
dealt up to the last round in one step that ends where the heap would. The table of
classes is what reaches the driver; n different sizes take at least n*n/2 bytes of
text, so 100 TB have fewer than 15 million and real corpora some thousands.

Groups are numbered by a range-partitioned sort, so each knows its place in its
class and with it its shard; no task holds more than its range. Slots are counted
per written partition and shard and made gapless by the partitions' offsets.

Defined cases: a null text is as an empty one (size 1); equal rows are all placed;
a group larger than a fair share is alone in its shard until the others fill up;
null doc_ids are placed like others; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urna.llm.common import stage

SHARDS = 8
#: Checked number of classes below which their table is broadcast.
BROADCAST_CLASSES = 500_000
#: Groups of a class that the heap deals one by one.
ONE_BY_ONE = 64


def _deal(loads: list[int], size: int, count: int) -> list[int]:
    """Groups each shard takes of ``count`` groups of one size, by the heap's rule; adds to ``loads``."""
    taken = [0] * len(loads)
    if count > ONE_BY_ONE:
        # The highest level that all places below it can be filled to.
        places = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
        low, high = min(loads), max(loads) + size * (count + 1)
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(places(level)) <= count else (low, level - 1)
        taken = places(low)
        for i, n in enumerate(taken):
            loads[i] += n * size
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
        taken[i] += 1
        loads[i] += size
    return taken


def schedule(classes, shards: int) -> list[tuple[int, int, list[int]]]:
    """(size, groups before the class, running sums of what the shards take) by falling size."""
    loads, before, out = [0] * shards, 0, []
    for size, count in sorted(classes, reverse=True):
        taken, running = _deal(loads, size, count), []
        for n in taken:
            running.append((running[-1] if running else 0) + n)
        out.append((size, before, running))
        before += count
    return out


def _numbered(df: DataFrame) -> DataFrame:
    """A written table with its partition and place there, in the order of writing."""
    done = stage(df.withColumn("id_", F.monotonically_increasing_id()))
    return done.withColumn("part_", F.shiftright("id_", 33)).withColumn("at_", F.col("id_").bitwiseAND(F.lit((1 << 33) - 1)))


def _offsets(counts: DataFrame, *by: str) -> DataFrame:
    """``n_`` of all earlier partitions; one row a partition (and shard)."""
    over = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before_", F.coalesce(F.sum("n_").over(over), F.lit(0))).drop("n_")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by law ``bytes``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = stage(
        docs.select("doc_id", text.alias("raw")).select(
            "doc_id", (F.octet_length("raw") + 1).cast("bigint").alias("size"), F.crc32("raw").alias("text_crc32"),
            F.unhex(F.sha2("raw", 256)).alias("key"),
        )
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    # One number orders ties, so that equal sizes spread over the ranges.
    ranked = _numbered(groups.orderBy(F.desc("bytes"), "key"))
    offsets = _offsets(ranked.groupBy("part_").agg(F.count("*").alias("n_")))
    classes = schedule(((r.bytes, r["count"]) for r in ranked.groupBy("bytes").count().toLocalIterator()), shards)
    table = spark.createDataFrame(classes, "bytes bigint, start_ bigint, cuts_ array<bigint>")
    if len(classes) <= BROADCAST_CLASSES:
        table = F.broadcast(table)
    rank = F.col("before_") + F.col("at_") - F.col("start_")
    placed = stage(
        ranked.join(F.broadcast(offsets), "part_").join(table, "bytes").withColumn("rank_", rank)
        .select("key", F.size(F.filter("cuts_", lambda c: c <= F.col("rank_"))).alias("shard"))
    )
    done = _numbered(rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard"))
    counts = _offsets(done.groupBy("part_", "shard").agg(F.count("*").alias("n_")), "shard")
    inside = F.row_number().over(Window.partitionBy("part_", "shard").orderBy("at_")) - 1
    return done.withColumn("inside_", inside).join(F.broadcast(counts), ["part_", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before_") + F.col("inside_")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
