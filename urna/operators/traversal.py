"""Traversal of an election's page tree, and whether it is complete.

Pages and links are tables; a crawl is what is reachable from the election's first
page. Frontiers go down one level a round and unread pages are passed up the same
way, each round a written table, so the work is as many joins as the site has
levels, whatever the number of pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.functions.text import canonical_municipality
from urna.session import discard, stage

_KEYS = ["root_url", "url"]


def traverse(pages: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything reachable from ``roots`` (url), as a written table.

    ``pages`` (url, municipality), ``edges`` (parent_url, child_url). A page of a
    municipality is a leaf: its links are not followed. Returns root_url, url,
    parent_url, depth, read (the page exists), leaf, and unread: how many pages are
    missing at or below it. A page that several lead to counts below the first of
    them, by depth and then by address; a page is reached once.
    """
    known = stage(
        pages.groupBy("url").agg(F.max(canonical_municipality(F.col("municipality")).isNotNull()).alias("leaf"))
    )
    links = edges.select(F.col("parent_url").alias("parent_url"), F.col("child_url").alias("url")).where(F.col("url").isNotNull())

    def looked_up(found: DataFrame) -> DataFrame:
        joined = found.join(known, "url", "left")
        return stage(
            joined.select(
                *_KEYS, "parent_url", "depth", F.col("leaf").isNotNull().alias("read"), F.coalesce("leaf", F.lit(False)).alias("leaf")
            )
        )

    first = roots.select(F.col("url").alias("root_url"), "url").where(F.col("url").isNotNull()).distinct()
    levels = [looked_up(first.withColumn("parent_url", F.lit(None).cast("string")).withColumn("depth", F.lit(0)))]
    while True:
        frontier = levels[-1].where(F.col("read") & ~F.col("leaf")).select("root_url", F.col("url").alias("parent_url"))
        seen = reduce(DataFrame.unionByName, [level.select(*_KEYS) for level in levels])
        reached = frontier.join(links, "parent_url").groupBy(*_KEYS).agg(F.min("parent_url").alias("parent_url"))
        new = looked_up(reached.join(seen, _KEYS, "left_anti").withColumn("depth", F.lit(len(levels))))
        if new.isEmpty():
            discard(new)
            break
        levels.append(new)

    # Unread pages go up from the deepest level, summed map-side at every parent.
    below, done = None, []
    for level in reversed(levels):
        own = (~F.col("read")).cast("bigint")
        if below is None:
            counted = stage(level.withColumn("unread", own))
        else:
            carried = below.where(F.col("unread") > 0).groupBy("root_url", F.col("parent_url").alias("url")).agg(F.sum("unread").alias("more"))
            counted = stage(level.join(carried, _KEYS, "left").withColumn("unread", own + F.coalesce("more", F.lit(0))).drop("more"))
        done.append(counted)
        below = counted
    result = stage(reduce(DataFrame.unionByName, done))
    discard(known, *levels, *done)
    return result


def election_completeness(traversal: DataFrame, roots: DataFrame) -> DataFrame:
    """Per requested election: pages reached and unread, leaves, and whether its page sets may be used.

    ``roots``: url, category, election_date and, if known, availability (as
    ``rendered_election`` gives it). An election the site does not offer is complete
    without pages.
    """
    offered = F.col("availability") == "available" if "availability" in roots.columns else F.lit(True)
    asked = roots.withColumn("available", F.coalesce(offered, F.lit(False))).select(
        F.col("url").alias("root_url"), "category", "election_date", "available"
    ).distinct()
    counted = traversal.groupBy("root_url").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.col("leaf").cast("bigint")).alias("municipality_pages"),
        F.max("depth").alias("depth"),
        F.max(F.when(F.col("depth") == 0, F.col("unread"))).alias("unread"),
    )
    none = F.lit(0).cast("bigint")
    count = lambda c: F.when(F.col("available"), F.coalesce(c, none)).otherwise(none).alias(c)
    return asked.join(counted, "root_url", "left").select(
        "root_url", "category", "election_date", "available", count("pages"), count("municipality_pages"), count("unread"),
        F.when(F.col("available"), F.col("depth")).alias("depth"),
        (~F.col("available") | F.coalesce(F.col("unread") == 0, F.lit(False))).alias("complete"),
    )


def complete_leaves(pages: DataFrame, traversal: DataFrame, elections: DataFrame) -> DataFrame:
    """The municipality pages reached by complete traversals, with the category of their election.

    These may be assembled into sets; an election with a page missing gives none.
    """
    usable = elections.where(F.col("complete") & F.col("available")).select("root_url", "category")
    reached = traversal.where("leaf").join(usable, "root_url").select("url", "category").distinct()
    return pages.drop("category").join(reached, "url")


def tree_edges(traversal: DataFrame) -> DataFrame:
    """(parent_url, child_url) of municipality pages and the page each was reached from."""
    return traversal.where(F.col("leaf") & F.col("parent_url").isNotNull()).select("parent_url", F.col("url").alias("child_url")).distinct()
