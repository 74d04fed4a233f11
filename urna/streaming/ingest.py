"""Resumable pick-up of new archives as an ``availableNow`` file stream.

The checkpoint of the stream remembers which files were read, so a restarted
run imports only new ones; each micro-batch replaces whole archives, so a batch
that is retried after a failure leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urna.operators.normalise import normalise
from urna.session import stage
from urna.sinks.tables import replace_archives
from urna.sources.archives import read_archives, with_election


def ingest_archives(
    spark: SparkSession,
    folder: str,
    catalogue: DataFrame,
    tables: str,
    checkpoint: str,
    *,
    files_per_batch: int = 64,
):
    """Import every archive of a folder not imported before; returns the query."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path", "content")
    )

    def load(batch: DataFrame, number: int) -> None:
        rows, unreadable = read_archives(batch)
        digests = stage(batch.select("path", F.sha2("content", 256).alias("sha256")))
        read = stage(rows)
        matched, unknown = with_election(read, catalogue)
        raw = stage(matched)
        # Archives without a row are imported too: their old rows must go.
        entries, _ = with_election(digests.join(unreadable.select("path"), "path", "left_anti"), catalogue)
        entries = stage(entries)
        counts = raw.groupBy("path").agg(F.count("*").alias("rows"))
        listed = entries.join(counts, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        replace_archives(
            {"archive_rows": raw, "election_results": normalise(raw), "catalogue": listed}, tables, entries
        )
        # One folder a batch: a retried batch replaces its own rejects.
        rejects = unreadable.unionByName(unknown).withColumn("seen_at", F.current_timestamp())
        rejects.write.mode("overwrite").parquet(f"{tables}/rejects/batch_id={number}")

    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
