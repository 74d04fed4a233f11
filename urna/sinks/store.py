"""Several tables that change in one step.

A commit writes the new rows of the elections it touches into folders of its own,
then a list of which folder holds each election of each table, and last a file that
makes that list the current one. Readers follow that file, so they see all of a
commit or nothing of it, and a commit that fails half-way leaves only folders that
nobody refers to. Two writers cannot both become the next version: the file is
created, never replaced.

    root/data/<table>/commit=<id>/category=.../election_date=.../
    root/lists/<id>/          table, commit, category, election_date
    root/versions/<number>    the id of the list that is current
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urna.operators.upsert import latest
from urna.session import stage

ELECTION = ("category", "election_date")
_LIST = "name string, commit string, category string, election_date date"
ROWS_PER_FILE = 5_000_000


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, list id) of every version, the newest first: one small file each."""
    files, folder = _files(spark, f"{root}/versions")
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit():
            source = files.open(status.getPath())
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
            # A line without its end was never finished.
            if text.endswith("\n"):
                found.append((int(name), text.strip()))
    return sorted(found, reverse=True)


def version(spark: SparkSession, root: str) -> int:
    """Number of the current version, 0 where nothing was committed."""
    return next((n for n, _ in _versions(spark, root)), 0)


def _list(spark: SparkSession, root: str, number: int | None) -> DataFrame:
    known = _versions(spark, root)
    chosen = next((i for n, i in known if number is None or n == number), None)
    if chosen is None:
        if number:
            raise ValueError(f"no version {number} in {root}")
        return spark.createDataFrame([], _LIST)
    return spark.read.schema(_LIST).parquet(f"{root}/lists/{chosen}")


def read(spark: SparkSession, root: str, name: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """A table of the current version, or of an earlier one; empty where it was never written.

    The list, one row an election, prunes the folders that are read.
    """
    held = _list(spark, root, number).where(F.col("name") == name).drop("name")
    files, folder = _files(spark, f"{root}/data/{name}")
    if not files.exists(folder):
        return spark.createDataFrame([], schema)
    stored = T.StructType([f for f in schema.fields if f.name not in ELECTION])
    stored = stored.add("commit", "string").add("category", "string").add("election_date", "date")
    rows = spark.read.schema(stored).parquet(f"{root}/data/{name}")
    return rows.join(F.broadcast(held), ["commit", *ELECTION], "left_semi").select(*[f.name for f in schema.fields])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], elections: DataFrame) -> int:
    """Replace the given elections in every table given; returns the new version's number.

    ``elections`` (category, election_date): what is replaced; rows of others are refused.
    """
    number, own = version(spark, root), uuid.uuid4().hex
    held = _list(spark, root, number or None)
    touched = stage(elections.select(*ELECTION).distinct())
    for name, rows in tables.items():
        if not rows.join(touched, list(ELECTION), "left_anti").isEmpty():
            raise ValueError(f"{name} holds rows of elections that are not given")
        (
            rows.hint("rebalance", *ELECTION).write.option("maxRecordsPerFile", ROWS_PER_FILE)
            .partitionBy(*ELECTION).parquet(f"{root}/data/{name}/commit={own}")
        )
    names = spark.createDataFrame([(n,) for n in tables], "name string")
    replaced = names.join(F.broadcast(touched))
    kept = held.join(replaced, ["name", *ELECTION], "left_anti")
    new = replaced.select("name", F.lit(own).alias("commit"), *ELECTION)
    # One row an election and table.
    kept.select(*new.columns).unionByName(new).coalesce(1).write.parquet(f"{root}/lists/{own}")
    files, place = _files(spark, f"{root}/versions/{number + 1:012d}")
    out = files.create(place, False)
    try:
        out.write(bytearray(f"{own}\n".encode()))
    finally:
        out.close()
    return number + 1


def clean(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove the folders that none of the last ``keep`` versions refers to; returns how many.

    Not while a commit is being written: its folders are not referred to yet.
    """
    known = _versions(spark, root)
    used: set[tuple[str, str]] = set()
    for _, own in known[:keep]:
        # As many rows as there are commits and tables.
        used |= {(r.name, r.commit) for r in spark.read.schema(_LIST).parquet(f"{root}/lists/{own}").select("name", "commit").distinct().collect()}
    removed = 0
    files, data = _files(spark, f"{root}/data")
    if files.exists(data):
        for table in files.listStatus(data):
            for part in files.listStatus(table.getPath()):
                name, own = table.getPath().getName(), part.getPath().getName().removeprefix("commit=")
                if (name, own) not in used:
                    files.delete(part.getPath(), True)
                    removed += 1
    for number, own in known[keep:]:
        for path in (f"{root}/versions/{number:012d}", f"{root}/lists/{own}"):
            files, place = _files(spark, path)
            files.delete(place, True)
    return removed


# Verification -------------------------------------------------------------------

_KINDS = {
    "date": T.DateType(), "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
}


def _columns(**kinds: str) -> T.StructType:
    """An election's columns and, by type, the others."""
    out = T.StructType().add("category", T.StringType()).add("election_date", T.DateType())
    for kind, names in kinds.items():
        for name in names.split():
            out = out.add(name, _KINDS[kind])
    return out


VERIFICATIONS = _columns(
    string="municipality_key municipality status completeness", timestamp="verified_at", boolean="complete_set",
    bigint="official_pages official_electors official_voters official_valid_votes", strings="source_urls",
)
RESULTS = _columns(string="municipality_key result_type subject subject_key", bigint="round votes seats", double="percentage")
QUEUE = _columns(
    bigint="round priority attempts", string="municipality_key region province constituency municipality status last_error",
    strings="source_urls", timestamp="updated_at",
)
_KEY = [*ELECTION, "municipality_key"]


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a stored table, null where they are not given."""
    given = set(df.columns)
    column = lambda f: (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
    return df.select(*[column(f) for f in schema.fields])


def store_queue(spark: SparkSession, root: str, queue: DataFrame) -> int:
    """Replace the queue's elections."""
    rows = shaped(queue, QUEUE)
    return commit(spark, root, {"queue": rows}, rows)


def store_verifications(spark: SparkSession, root: str, verifications: DataFrame, results: DataFrame) -> int:
    """Put verifications over the stored ones, replace their result rows and mark their queue items, in one version.

    Of several verifications of a place the latest counts. ``results`` holds the
    published subjects by the same key; no published round is stored as -1. Only the
    elections of the verifications are rewritten.
    """
    incoming = stage(latest(shaped(verifications, VERIFICATIONS), _KEY, ["verified_at"]))
    touched = incoming.select(*ELECTION).distinct()
    inside = lambda name, schema: read(spark, root, name, schema).join(F.broadcast(touched), list(ELECTION), "left_semi")
    keys = incoming.select(*_KEY)
    merged = inside("verifications", VERIFICATIONS).join(keys, _KEY, "left_anti").unionByName(incoming)
    no_round = F.lit(-1).cast("bigint")
    own = shaped(results, RESULTS).join(keys, _KEY, "left_semi").withColumn(
        "round", F.coalesce(F.nullif("round", F.lit(0).cast("bigint")), no_round)
    )
    children = inside("results", RESULTS).join(keys, _KEY, "left_anti").unionByName(own)
    marks = incoming.select(
        *_KEY, F.when(F.col("complete_set"), "verified").otherwise("partial").alias("new_status"),
        F.col("source_urls").alias("new_urls"), F.col("verified_at").alias("marked_at"),
    )
    hit = F.col("new_status").isNotNull()
    queue = inside("queue", QUEUE).join(marks, _KEY, "left").withColumns(
        {
            "status": F.coalesce("new_status", "status"), "attempts": F.col("attempts") + hit.cast("bigint"),
            "source_urls": F.when(hit, F.col("new_urls")).otherwise(F.col("source_urls")),
            "last_error": F.when(~hit, F.col("last_error")), "updated_at": F.coalesce("marked_at", "updated_at"),
        }
    ).select(*[f.name for f in QUEUE.fields])
    tables = {"verifications": merged, "results": children, "queue": queue}
    return commit(spark, root, tables, touched)
