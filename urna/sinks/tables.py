"""Partitioned tables: whole partitions are replaced, never single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urna.operators.upsert import merge
from urna.session import stage

PARTITIONS = ("category", "election_date")


#: Rows of one written file.
ROWS_PER_FILE = 5_000_000


def _replace(df: DataFrame, path: str, partitions: tuple[str, ...]) -> None:
    # Rebalancing splits a large partition and joins small ones by their size.
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*partitions)
        .parquet(path)
    )


def _drop(path: str, partitions: tuple[str, ...], given: DataFrame, rows: DataFrame) -> None:
    """Remove the stored partitions that are given but have no new rows.

    A list of partitions, as long as the import; never of rows.
    """
    spark = given.sparkSession
    gone = given.select(*partitions).distinct().join(rows.select(*partitions).distinct(), list(partitions), "left_anti")
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in gone.toLocalIterator():
        place = root
        for name, value in zip(partitions, row, strict=True):
            place = spark._jvm.org.apache.hadoop.fs.Path(place, escape.getPartitionPathString(name, None if value is None else str(value)))
        if files.exists(place):
            files.delete(place, True)


def replace_archives(tables: dict[str, DataFrame], folder: str, archives: DataFrame) -> None:
    """Replace the rows of the archives given in every table, and no others.

    ``archives`` holds (category, election_date, archive) of all that is imported;
    one that has no rows in a table any more keeps none there.
    """
    keys = (*PARTITIONS, "archive")
    for name, rows in tables.items():
        _replace(rows, f"{folder}/{name}", keys)
        _drop(f"{folder}/{name}", keys, archives, rows)


def append_snapshots(snapshots: DataFrame, folder: str) -> None:
    snapshots.write.mode("append").parquet(f"{folder}/page_snapshots")


def replace_elections(rows: DataFrame, path: str, elections: DataFrame | None = None) -> None:
    """Replace the rows of the elections given, by default those present in ``rows`` (closures)."""
    _replace(rows, path, PARTITIONS)
    if elections is not None:
        _drop(path, PARTITIONS, elections, rows)


def upsert(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Merge rows into a table; only the elections they touch are rewritten.

    The merged rows are staged before the partitions they came from are replaced.
    """
    try:
        stored = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        _replace(incoming, path, PARTITIONS)
        return
    touched = stored.join(incoming.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")
    merged = merge(touched.select(*incoming.columns), incoming, keys, order)
    _replace(stage(merged), path, PARTITIONS)
