"""The verification work queue and the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.text import canonical_municipality, geography_key

QUEUE_KEY = ("category", "election_date", "round", "municipality_key")
QUEUE_CATEGORIES = ("camera", "senato", "europee", "regionali", "comunali")
QUEUE_STATUSES = ("pending", "partial", "verified", "failed")
TERMINAL = ("complete", "unavailable")
_COMPLETED = ("complete", "unavailable", "failed")


def queue_candidates(facts: DataFrame) -> DataFrame:
    """One work item per place and round, the most urgent reading first.

    Priority grows with the voters; places published under a part's label or in
    several colleges come first.  Round -1 means none was published.
    """
    grouped = (
        facts.where(F.col("municipality").isNotNull())
        .groupBy("category", "election_date", "region", "province", "constituency", "municipality", "round")
        .agg(
            F.max(F.coalesce("voters", F.lit(0))).alias("voters"),
            F.countDistinct("college").alias("colleges"),
        )
        .withColumnRenamed("municipality", "label")
        .withColumn("municipality", canonical_municipality(F.col("label")))
        .where(F.col("municipality").isNotNull())
    )
    scale = F.least(F.floor(F.col("voters") / 10000), F.lit(100)).cast("bigint")
    divided = (F.col("municipality") != F.col("label")) | (F.col("colleges") > 1)
    items = grouped.select(
        "category", "election_date",
        F.coalesce("round", F.lit(-1)).cast("bigint").alias("round"),
        geography_key(
            F.col("municipality"), F.col("province"), F.col("region"), F.col("constituency")
        ).alias("municipality_key"),
        "region", "province", "constituency", "municipality",
        (scale + F.when(divided, 1000).otherwise(0)).alias("priority"),
    )
    # Highest priority; a fixed order of the published geography breaks ties.
    order = F.struct(
        -F.col("priority"), "region", "province", "constituency", "municipality"
    )
    kept = F.struct("region", "province", "constituency", "municipality", "priority")
    return items.groupBy(*QUEUE_KEY).agg(F.min_by(kept, order).alias("i")).select(*QUEUE_KEY, "i.*")


def merge_queue(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """Upsert: new geography where known, the higher priority, status kept."""
    old = queue.select(*QUEUE_KEY, *[F.col(c).alias(f"old_{c}") for c in queue.columns if c not in QUEUE_KEY])
    joined = candidates.join(old, list(QUEUE_KEY), "full_outer")
    return joined.select(
        *QUEUE_KEY,
        *[F.coalesce(c, f"old_{c}").alias(c) for c in ("region", "province", "constituency", "municipality")],
        F.greatest("priority", "old_priority").alias("priority"),
        F.coalesce("old_status", F.lit("pending")).alias("status"),
        F.coalesce("old_attempts", F.lit(0)).cast("bigint").alias("attempts"),
    )


def empty_queue(candidates: DataFrame) -> DataFrame:
    """A queue without items, in the shape :func:`merge_queue` returns."""
    return candidates.select(
        "*", F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts")
    ).limit(0)


def apply_verifications(queue: DataFrame, verifications: DataFrame) -> DataFrame:
    """Status of each item from the stored verification of its place.

    A verification under an old bare key counts only if exactly one item of its
    election ends in that key.  Its ``source_urls``, if it has them, go to the item.
    """
    election = ["category", "election_date"]
    carried = "source_urls" in verifications.columns
    urls = F.col("source_urls") if carried else F.lit(None).cast("array<string>")
    stored = verifications.select(
        *election, "verification_key",
        F.when(F.col("complete_set"), "verified").otherwise("partial").alias("new_status"),
        "verified_at", urls.alias("urls"),
    )
    bare_item = F.substring_index("municipality_key", "|", -1)
    old = stored.where(~F.col("verification_key").contains(":"))
    sole = (
        queue.select(*QUEUE_KEY, bare_item.alias("verification_key"))
        .join(old.select(*election, "verification_key"), [*election, "verification_key"], "left_semi")
        .groupBy(*election, "verification_key")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.min("round").alias("round"),
            F.min("municipality_key").alias("municipality_key"),
        )
        .where(F.col("items") == 1)
    )
    by_bare = old.join(sole, [*election, "verification_key"]).select(
        *QUEUE_KEY, F.col("new_status").alias("bare_status"), F.col("verified_at").alias("bare_at"), F.col("urls").alias("bare_urls")
    )
    by_key = stored.select(
        *election, F.col("verification_key").alias("municipality_key"),
        "new_status", F.col("verified_at").alias("key_at"), F.col("urls").alias("key_urls"),
    )
    marked = (
        queue.join(by_key, [*election, "municipality_key"], "left")
        .join(by_bare, list(QUEUE_KEY), "left")
        .withColumn("status", F.coalesce("bare_status", "new_status", "status"))
        .withColumn("updated_at", F.coalesce("bare_at", "key_at"))
    )
    if carried:
        marked = marked.withColumn("source_urls", F.when(F.col("updated_at").isNotNull(), F.coalesce("bare_urls", "key_urls")))
    return marked.drop("bare_status", "new_status", "bare_at", "key_at", "bare_urls", "key_urls")


def list_queue(
    queue: DataFrame, *, category: str | None = None, election_date=None, status: str | None = None
) -> DataFrame:
    """Items by urgency; no published round reads as NULL."""
    if category is not None and category not in QUEUE_CATEGORIES:
        raise ValueError("unsupported election category")
    if status is not None and status not in QUEUE_STATUSES:
        raise ValueError("unsupported queue status")
    out = queue
    if category:
        out = out.where(F.col("category") == category)
    if election_date:
        out = out.where(F.col("election_date") == F.lit(election_date))
    if status:
        out = out.where(F.col("status") == status)
    return out.withColumn("round", F.nullif(F.col("round"), F.lit(-1).cast("bigint"))).orderBy(*urgency())


def urgency() -> tuple:
    """The order of the list: priority, then date, category and municipality."""
    return (F.col("priority").desc(), "election_date", "category", "municipality")


def ledger_merge(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Fold run events (category, election_date, status, at, sequence) into the ledger.

    The latest event decides status, completion, ``result`` and ``last_error``, where
    events carry these: an event without them clears them.  A run starts at its last
    ``running`` event, or at the first event ever recorded.
    """
    key = ["category", "election_date"]
    notes = [c for c in ("result", "last_error") if c in events.columns]
    none = lambda c, df: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    past = ledger.select(
        *key, "status", F.col("started_at").alias("at"), F.lit(-1).cast("bigint").alias("sequence"), "completed_at", *[none(c, ledger) for c in notes]
    )
    now = events.select(*key, "status", "at", "sequence", F.when(F.col("status").isin(*_COMPLETED), F.col("at")).alias("completed_at"), *notes)
    both = past.unionByName(now)
    running = F.when((F.col("status") == "running") & (F.col("sequence") >= 0), F.col("sequence"))
    last = F.max_by(F.struct("completed_at", *notes), "sequence")
    return both.groupBy(*key).agg(
        F.max_by("status", "sequence").alias("status"),
        F.coalesce(F.max_by("at", running), F.min_by("at", "sequence")).alias("started_at"),
        *[last[c].alias(c) for c in ("completed_at", *notes)],
    )


def pending_elections(
    imported: DataFrame, ledger: DataFrame, *, retry_complete: bool = False
) -> DataFrame:
    """Imported elections whose run has not ended, in date order."""
    key = ["category", "election_date"]
    out = imported.select(*key).distinct()
    if not retry_complete:
        out = out.join(ledger.where(F.col("status").isin(*TERMINAL)).select(*key), key, "left_anti")
    return out.orderBy("election_date", "category")


def next_elections(pending: DataFrame, count: int) -> DataFrame:
    return pending.orderBy("election_date", "category").limit(count)


def best_available(archive_rows: DataFrame, official_rows: DataFrame) -> DataFrame:
    """Verified official rows where there are any, archive rows elsewhere."""
    key = ["place", "category", "election_date"]
    covered = official_rows.select(*key).distinct()
    return (
        official_rows.withColumn("fonte", F.lit("official_municipality_pages"))
        .unionByName(
            archive_rows.join(covered, key, "left_anti").withColumn("fonte", F.lit("open_data"))
        )
    )


def unrecorded_verifications(verifications: DataFrame, results: DataFrame) -> DataFrame:
    """Stored verifications that lack result rows."""
    key = ["category", "election_date", "verification_key"]
    return verifications.join(results.select(*key), key, "left_anti")
