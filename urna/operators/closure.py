"""Parent pages against the sum of their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna.functions.text import slug
from urna.operators.layers import strict_sum


def _first_round() -> Column:
    return F.col("round").isNull() | (F.col("round") == 1)


def page_subjects(pages: DataFrame) -> DataFrame:
    """Votes per (page, record type, subject) of the first round, totals left out."""
    return (
        pages.select("url", F.explode("records").alias("r"))
        .select("url", "r.*")
        .where(~F.col("record_type").isin("total", "coalition_total"))
        .where(F.col("votes").isNotNull() & _first_round())
        .withColumn("subject_key", slug(F.col("name")))
        .groupBy("url", "record_type", "subject_key")
        .agg(F.sum("votes").alias("votes"))
    )


def page_valid_votes(pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """Printed totals, else the sum of the lists, else NULL."""
    printed = (
        pages.select("url", F.explode("records").alias("r"))
        .select("url", "r.*")
        .where((F.col("record_type") == "total") & F.col("votes").isNotNull() & _first_round())
        .groupBy("url")
        .agg(F.sum("votes").alias("printed"))
    )
    lists = (
        subjects.where(F.col("record_type") == "list")
        .groupBy("url")
        .agg(F.sum("votes").alias("lists"))
    )
    return (
        pages.select("url")
        .join(printed, "url", "left")
        .join(lists, "url", "left")
        .select("url", F.coalesce("printed", "lists").alias("valid_votes"))
    )


def parent_closures(pages: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closure per parent, and the mismatching subjects as rows of their own.

    ``edges`` (parent_url, child_url) lead to municipality pages.  Everything is
    summed map-side, so a parent with very many children stays one group of
    partial sums; no list of children or subjects is gathered.
    """
    subjects = page_subjects(pages)
    figures = pages.select("url", "label", "electors", "voters").join(
        page_valid_votes(pages, subjects), "url"
    )
    links = edges.select("parent_url", "child_url").distinct()
    below = (
        links.join(figures.withColumnRenamed("url", "child_url"), "child_url")
        .groupBy("parent_url")
        .agg(
            F.count(F.lit(1)).alias("child_pages"),
            strict_sum("electors").alias("child_electors"),
            strict_sum("voters").alias("child_voters"),
            strict_sum("valid_votes").alias("child_valid_votes"),
        )
    )
    above = figures.select(
        F.col("url").alias("parent_url"),
        F.col("label").alias("parent_label"),
        F.col("electors").alias("parent_electors"),
        F.col("voters").alias("parent_voters"),
        F.col("valid_votes").alias("parent_valid_votes"),
        F.lit(True).alias("found"),
    )
    subject_key = ["parent_url", "record_type", "subject_key"]
    children_votes = (
        links.join(subjects.withColumnRenamed("url", "child_url"), "child_url")
        .groupBy(*subject_key)
        .agg(F.sum("votes").alias("child_votes"))
    )
    parents = links.select("parent_url").distinct()
    parent_votes = subjects.withColumnRenamed("url", "parent_url").join(
        parents, "parent_url", "left_semi"
    ).withColumnRenamed("votes", "parent_votes")
    compared = children_votes.join(parent_votes, subject_key, "full_outer").withColumn(
        "differs", ~F.col("child_votes").eqNullSafe(F.col("parent_votes"))
    )
    tallies = compared.groupBy("parent_url").agg(
        F.count(F.lit(1)).alias("subjects_compared"),
        F.count_if(F.col("differs")).alias("subjects_mismatched"),
    )
    joined = below.join(above, "parent_url", "left").join(tallies, "parent_url", "left")
    found = F.coalesce("found", F.lit(False))
    pairs = [(f"parent_{m}", f"child_{m}") for m in ("electors", "voters", "valid_votes")]
    apart = F.coalesce("subjects_mismatched", F.lit(0)) > 0
    unknown = F.lit(False)
    for up, down in pairs:
        apart = apart | F.coalesce(F.col(up) != F.col(down), F.lit(False))
        unknown = unknown | F.col(up).isNull() | F.col(down).isNull()
    closures = joined.select(
        "parent_url", "parent_label", "child_pages",
        *[c for pair in pairs for c in pair],
        *[
            F.when(found, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
            for c in ("subjects_compared", "subjects_mismatched")
        ],
        F.when(~found, "parent_missing")
        .when(apart, "mismatch")
        .when(unknown, "incomplete")
        .otherwise("closed")
        .alias("status"),
    )
    known = above.select("parent_url")
    mismatches = (
        compared.where("differs")
        .join(known, "parent_url", "left_semi")
        .select(
            "parent_url",
            F.concat_ws(":", "record_type", "subject_key").alias("subject"),
            "parent_votes", "child_votes",
        )
    )
    return closures, mismatches


def child_index(edges: DataFrame, closures: DataFrame) -> DataFrame:
    """(child_url, parent_url, category, election_date) of every closed page, to be stored beside the closures.

    Stored and replaced by election as the closures are, it answers for any child
    without opening lists of children.
    """
    known = closures.select("parent_url", "category", "election_date")
    return edges.select("child_url", "parent_url").distinct().join(known, "parent_url").select(
        "child_url", "parent_url", "category", "election_date"
    )


def closures_of_children(closures: DataFrame, edges: DataFrame, children: DataFrame) -> DataFrame:
    """The closure of each given page's parent (children: url)."""
    return (
        children.select(F.col("url").alias("child_url"))
        .join(edges.select("parent_url", "child_url"), "child_url")
        .join(closures, "parent_url")
    )


def list_closures(closures: DataFrame, *, status: str | None = None) -> DataFrame:
    rows = closures if status is None else closures.where(F.col("status") == status)
    return rows.orderBy("parent_url")
