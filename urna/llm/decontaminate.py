"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes tokens. Numbers, units after a number, and runs of capitalised words
inside a sentence are replaced by a placeholder of their kind, everything else is
lower case without marks. Windows of ``WINDOW`` template tokens of the benchmark meet the
same windows of the documents in a hash join. Windows of one document and item
that lie on one diagonal (document place minus item place) belong together; they
cover some of the item's tokens. So do neighbouring diagonals, each at most ``GAP``
from the next, as words put in or left out shift the rest; an item place that
several of them cover counts once, on the diagonal that covers most. A pair counts
as a leak if a diagonal or such a run covers ``enough`` tokens and its slots are
consistent: within it, equal values of the item always meet equal values of the
document. So a question with other numbers or names is caught, and a text that
merely has the same shape with unrelated values is not.

Windows that are mostly placeholders say nothing as templates: on both sides their
key is made of the tokens with their values, so number- or name-heavy items are
found where they are copied verbatim. Items shorter than a window are compared whole:
such an item leaks wherever all its tokens stand in a row, however few they are. The
benchmark's windows are broadcast if there are at most ``BROADCAST_WINDOWS`` of them, else joined by shuffle.

Defined cases: null and empty texts have no tokens and no leaks; items without
tokens match nothing; rows without doc_id or item_id are in no pair (and stay in
``clean``); rows that share a doc_id are one document; equal items are each
reported; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Template tokens of a window, and tokens a diagonal covers at most to count.
WINDOW, ENOUGH = 6, 13
#: Tokens between neighbouring diagonals.
GAP = 3
#: Checked size below which the benchmark's windows are broadcast (some 40 bytes each).
BROADCAST_WINDOWS = 500_000

# Signs of the placeholders, from the private use area, and of a mark inside a number.
NAME, NUMBER, UNIT, INNER = "", "", "", ""

#: Units that follow a number.
UNITS = (
    "km kilometers kilometres kilometer kilometre m meters metres meter metre cm mm miles mile feet foot ft inches inch "
    "yards yard kg kilograms kilogram g grams gram mg tons tonnes ton pounds pound lbs lb ounces ounce oz l liters litres "
    "liter litre ml gallons gallon seconds second minutes minute hours hour days day weeks week months month years year "
    "dollars dollar euros euro cents cent percent degrees degree mph kmh kw watts watt volts volt"
).split()


def _marked(text: Column) -> Column:
    """The text's tokens, a blank apart, slots still with their values behind their sign."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    x = F.coalesce(text, F.lit(""))
    x = F.regexp_replace(x, "[-]", " ")
    x = F.regexp_replace(x, r"\p{Lu}(?<=[\p{Ll}\p{N},;] .)\p{Ll}+(?![\p{L}\p{N}])", NAME + "$0" + INNER)
    # Names a blank apart are one.
    x = F.regexp_replace(F.replace(x, F.lit(f"{INNER} {NAME}"), F.lit(INNER)), rf"{INNER}(?!\p{{Lu}})", "")
    x = F.regexp_replace(x, r"[.,:/](?<=\p{N}.)(?=\p{N})", INNER)
    x = F.regexp_replace(x, rf"(\p{{N}}) ?((?i:{units}))(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    x = F.regexp_replace(x, rf"\p{{N}}(?<![\p{{L}}\p{{N}}{INNER}].)[\p{{N}}{INNER}]*(?![\p{{L}}])", NUMBER + "$0")
    x = F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}\p{{M}}{NAME}-{INNER}]+", " ")
    return F.trim(F.lower(x))


def _template(marked: Column) -> Column:
    """Placeholders without their values."""
    return F.regexp_replace(marked, f"([{NAME}-{UNIT}])[^ ]*", "$1")


def _tokens(joined: Column) -> Column:
    # An empty text splits into one empty token.
    return F.filter(F.split(joined, " "), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row.

    An expression that a lambda mentions is otherwise evaluated for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(token: Column) -> Column:
    return (token < NAME) | (token >= INNER)


def _key(size: int | Column, start: Column, templates: Column, values: Column, literal: Column) -> Column:
    """Hash of a window's templates, or of its values if fewer than half of its tokens are literal."""
    telling = 2 * F.size(F.array_remove(F.slice(literal, start, size), 0)) >= size
    return F.when(telling, F.xxhash64(F.slice(templates, start, size))).otherwise(F.xxhash64(F.slice(values, start, size)))


def _windows(marked: Column, size: int | Column) -> Column:
    """Key of every window; none if there are fewer tokens."""

    def keys(templates: Column, values: Column, literal: Column) -> Column:
        last = F.size(values) - size + 1
        return F.when(last >= 1, F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: _key(size, i, templates, values, literal)
        ))

    def hashes(tokens: Column) -> Column:
        return F.transform(tokens, lambda w: F.xxhash64(w))

    return _let(hashes(_tokens(_template(marked))), lambda t: _let(_tokens(marked), lambda m: _let(
        hashes(m), lambda v: _let(F.transform(m, lambda w: _literal(w).cast("int")), lambda n: keys(t, v, n))
    )))


def _benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(size, key, item_id, item_place, n_tokens) of every window."""
    items = (
        benchmark.where(F.col("item_id").isNotNull())
        .select("item_id", _marked(F.col("text")).alias("marked"))
        .withColumn("n_tokens", F.size(_tokens(F.col("marked")))).where("n_tokens > 0")
        .withColumn("size", F.least(F.col("n_tokens"), F.lit(WINDOW)))
    )
    return items.select(
        "size", "item_id", "n_tokens", F.posexplode(_windows(F.col("marked"), F.col("size"))).alias("item_place", "key")
    ).withColumn("item_place", F.col("item_place") + 1)


def _matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, item_id, diagonal, ...) with the item places that meet there."""
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # WINDOW values at most
    small = windows.count() <= BROADCAST_WINDOWS
    marked = docs.select("doc_id", _marked(F.col("text")).alias("marked"))
    found = None
    for size in sizes:
        placed = marked.select("doc_id", F.posexplode(_windows(F.col("marked"), size)).alias("doc_place", "key"))
        own = windows.where(F.col("size") == size)
        met = placed.join(F.broadcast(own) if small else own, "key")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return None
    return (
        found.withColumn("diagonal", F.col("doc_place") + 1 - F.col("item_place"))
        .groupBy("doc_id", "item_id", "diagonal", "n_tokens", "size")
        .agg(F.collect_set("item_place").alias("places"))
    )


def enough(n_tokens: Column) -> Column:
    """Tokens a diagonal must cover: half the item, and never more than ``ENOUGH``."""
    return F.least(F.lit(ENOUGH), F.ceil(n_tokens / 2))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, n_tokens, kind) of every leaked pair; kind: verbatim or reparameterised."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = _matches(docs, _benchmark_windows(benchmark))
    if found is None:
        return docs.select(
            "doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("covered"), F.lit(0).alias("n_tokens"),
            F.lit("").alias("kind"),
        ).where(F.lit(False))
    # Which places of an item are slots: as many rows as the benchmark has items.
    tokens = benchmark.where(F.col("item_id").isNotNull()).select("item_id", _tokens(_marked(F.col("text"))).alias("t"))
    slots = tokens.select("item_id", F.filter(
        F.transform("t", lambda w, i: F.when(~_literal(w), i + 1)), lambda i: i.isNotNull()
    ).alias("slots")).distinct()
    covered = F.array_sort(F.array_distinct(F.flatten(
        F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1))
    )))
    pair = ["doc_id", "item_id", "n_tokens"]
    in_turn = Window.partitionBy("doc_id", "item_id").orderBy("diagonal")
    lines = (
        found.select(*pair, "diagonal", covered.alias("cover"))
        .withColumn("apart", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_turn), F.lit(0)) > GAP).cast("int"))
        .withColumn("run", F.sum("apart").over(in_turn)).withColumn("n", F.size("cover"))
    )
    reaches = F.col("covered") >= enough(F.col("n_tokens"))

    def cell(place: Column, diagonal: Column) -> Column:
        return F.struct(place.alias("place"), (place + diagonal).alias("at"))

    one = lines.select(
        *pair, F.col("n").alias("covered"), F.transform("cover", lambda p: cell(p, F.col("diagonal"))).alias("cells")
    ).where(reaches)
    # Of the diagonals that cover a place of the item the one that covers most, place by
    # place, as a text of few different words has a diagonal for each of its places.
    best = F.max(F.struct("n", (-F.col("diagonal")).alias("back"), "diagonal"))
    several = (
        lines.select(*pair, "run", "n", "diagonal", F.explode("cover").alias("place"))
        .groupBy(*pair, "run", "place").agg(best.alias("best"), F.min("diagonal").alias("least"), F.max("diagonal").alias("most"))
        .groupBy(*pair, "run").agg(
            F.collect_list(cell(F.col("place"), F.col("best.diagonal"))).alias("cells"),
            (F.min("least") < F.max("most")).alias("more"), F.count(F.lit(1)).cast("int").alias("covered"),
        )
        .where(reaches & F.col("more")).select(*pair, "covered", F.array_sort("cells").alias("cells"))
    )
    likely = one.unionByName(several).join(slots, "item_id").withColumn("open", F.arrays_overlap("cells.place", "slots"))
    # Without a slot there are no values to look at; with one, all of a pair's lines share one reading of the text.
    settled = likely.where(~F.col("open")).groupBy(*pair).agg(F.max(F.struct("covered", F.lit("verbatim").alias("kind"))).alias("best"))
    asked = likely.where("open").groupBy(*pair).agg(F.collect_list(F.struct("covered", "cells")).alias("lines"))
    both = asked.join(tokens, "item_id").join(docs, "doc_id")

    def values(cells: Column, item: Column, doc: Column) -> Column:
        return F.array_distinct(F.transform(
            F.filter(cells, lambda c: ~_literal(F.get(item, c["place"] - 1))),
            lambda c: F.struct(F.get(item, c["place"] - 1).alias("a"), F.get(doc, c["at"] - 1).alias("b")),
        ))

    def judged(line: Column, met: Column) -> Column:
        consistent = F.size(F.array_distinct(F.transform(met, lambda v: v["a"]))) == F.size(met)
        kind = F.when(F.forall(met, lambda v: v["a"].eqNullSafe(v["b"])), "verbatim").otherwise("reparameterised")
        return F.when(consistent, F.struct(line["covered"].alias("covered"), kind.alias("kind")))

    checked = both.select(*pair, _let(_tokens(_marked(F.col("text"))), lambda d: F.array_max(F.transform(
        "lines", lambda x: _let(values(x["cells"], F.col("t"), d), lambda v: judged(x, v))
    ))).alias("best")).where(F.col("best").isNotNull())
    # Of several lines of a pair the longest, a verbatim one first.
    return settled.unionByName(checked).groupBy(*pair).agg(F.max("best").alias("best")).select(
        "doc_id", "item_id", F.col("best.covered").alias("covered"), "n_tokens", F.col("best.kind").alias("kind")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, columns unchanged."""
    leaked = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


