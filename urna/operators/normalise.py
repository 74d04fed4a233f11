"""From drifting raw rows to the tidy result-fact table.

Raw rows carry: archive, category, election_date, member_index, file_name,
row_number, region, constituency, province, municipality, municipality_key,
``payload`` (text by slugged column name) and ``numbers`` (spreadsheet cells
that were numbers).  All archives are normalised in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.numbers import as_int, percentage
from urna.functions.text import canonical_municipality, slug
from urna.operators.cells import read_cells
from urna.session import in_compiled_methods, stage

ARCHIVE = ("archive", "category", "election_date")
SUMMARY_KEY = (
    "region", "constituency", "province", "municipality_key", "country", "college", "round",
    "question_number",
)
CONTEXT = (
    "round", "region", "constituency", "province", "municipality", "municipality_key", "country",
    "college", "question_number", "question",
)
MEASURES = tuple(fv.MEASURES)
FACT_COLUMNS = (
    *ARCHIVE, *CONTEXT, "result_type", "subject", "subject_key", "party", "candidate", "option",
    "votes", "percentage", "seats", "electors", "male_electors", "voters", "male_voters",
    "turnout_percentage", "valid_votes", "valid_list_votes", "valid_candidate_votes",
    "blank_ballots", "invalid_ballots", "contested_ballots", "source_file", "source_row",
)
_KIND = (
    "array<struct<result_type:string,subject:string,party:string,candidate:string,"
    "option:string,votes:bigint>>"
)


def first_text(*names: str) -> Column:
    """First alias with a value."""
    return F.coalesce(*[F.nullif(F.try_element_at("payload", F.lit(n)), F.lit("")) for n in names])


def row_order() -> Column:
    """Position of a row in its archive: member, then row.

    A single decimal, not a struct: aggregates over it stay hash-based.
    """
    member = F.col("member_index").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    return (member + F.col("row_number").cast("decimal(19,0)")).cast("decimal(38,0)")


def _given(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def with_raw_geography(raw: DataFrame) -> DataFrame:
    """Region, constituency, province and canonical municipality of raw rows."""
    named = {
        column: first_text(*fv.RAW_GEOGRAPHY[column]) for column in ("region", "constituency", "province")
    }
    placed = raw.withColumns(
        named | {"municipality": canonical_municipality(first_text(*fv.RAW_GEOGRAPHY["municipality"]))}
    )
    return placed.withColumn("municipality_key", slug(F.col("municipality")))


#: Fields of a row that are read from its cells as text, before its own geography is regarded.
_TEXTS = {
    **{f"cell_{name}": fv.CONTEXT[name] for name in (
        "region", "region_prefix", "region_last", "constituency", "province", "municipality", "question_number",
    )},
    **{name: fv.CONTEXT[name] for name in ("country", "college", "question", "section")},
    **{name: fv.SUBJECTS[name] for name in ("party", "surname", "name")},
}
_INTEGERS = {
    "round": fv.CONTEXT["round"],
    **fv.MEASURES,
    **{name: fv.SUBJECTS[name] for name in ("party_votes", "candidate_votes", "seats", "yes_votes", "no_votes")},
}
_MARKS = {"not_aggregate": fv.NOT_AGGREGATE, "not_results": fv.NOT_RESULTS}


def read_columns(raw: DataFrame) -> DataFrame:
    """Resolve context, measures and subjects of every raw row, drop the payload."""
    carried = (
        *ARCHIVE, "member_index", "file_name", "row_number", "region", "constituency", "province", "municipality",
        "municipality_key",
    )
    cells = read_cells(raw, carried, _TEXTS, _INTEGERS, _MARKS)
    prefix = F.nullif(
        F.regexp_extract(F.upper("cell_region_prefix"), "^(" + "|".join(fv.REGIONS) + ")", 1), F.lit("")
    )
    question = F.col("cell_question_number")
    resolved = cells.select(
        *ARCHIVE,
        "member_index", "file_name", "row_number", "municipality_key", "round",
        F.coalesce(_given("region"), "cell_region", prefix, "cell_region_last").alias("region"),
        F.coalesce(_given("constituency"), "cell_constituency").alias("constituency"),
        F.coalesce(_given("province"), "cell_province").alias("province"),
        canonical_municipality(F.coalesce(_given("municipality"), "cell_municipality")).alias("municipality"),
        "country", "college",
        F.when(F.col("category") == "referendum", F.coalesce(question, F.lit("1")))
        .otherwise(question)
        .alias("question_number"),
        "question", "section", *MEASURES, "party", "party_votes",
        F.nullif(F.concat_ws(" ", "surname", "name"), F.lit("")).alias("candidate"),
        "candidate_votes", "seats", "yes_votes", "no_votes", *_MARKS,
    )
    return (
        resolved.withColumn(
            "municipality_key", F.coalesce(_given("municipality_key"), slug(F.col("municipality")))
        )
        .withColumn("turnout_percentage", percentage(F.col("voters"), F.col("electors")))
        .withColumn("order", row_order())
    )


def _yields_result() -> Column:
    """Whether a row publishes any subject; independent of its summary."""
    referendum = F.col("yes_votes").isNotNull() | F.col("no_votes").isNotNull()
    subject = (F.col("party").isNotNull() & F.col("party_votes").isNotNull()) | (
        F.col("candidate").isNotNull() & F.col("candidate_votes").isNotNull()
    )
    return F.when(F.col("category") == "referendum", referendum).otherwise(subject)


def _specs() -> Column:
    """Subjects a row publishes, as an array: two options, one list, one candidate or none."""
    null = F.lit(None).cast("string")

    def spec(kind: str, subject: Column, votes: Column, party=null, candidate=null, option=null):
        return F.struct(
            F.lit(kind).alias("result_type"), subject.alias("subject"), party.alias("party"),
            candidate.alias("candidate"), option.alias("option"), votes.alias("votes"),
        )

    options = F.filter(
        F.array(
            spec("option", F.lit("SI"), F.col("yes_votes"), option=F.lit("SI")),
            spec("option", F.lit("NO"), F.col("no_votes"), option=F.lit("NO")),
        ),
        lambda s: s["votes"].isNotNull(),
    )
    party, candidate = F.col("party"), F.col("candidate")
    return (
        F.when(F.col("category") == "referendum", options)
        .when(
            party.isNotNull() & F.col("party_votes").isNotNull(),
            F.array(spec("list", party, F.col("party_votes"), party=party, candidate=candidate)),
        )
        .when(
            candidate.isNotNull() & F.col("candidate_votes").isNotNull(),
            F.array(spec("candidate", candidate, F.col("candidate_votes"), candidate=candidate)),
        )
        .otherwise(F.array().cast(_KIND))
    )


def _derive_no(rows: DataFrame) -> DataFrame:
    """Missing NO votes from valid votes less YES votes."""
    derived = F.when(
        (F.col("category") == "referendum") & (F.col("valid_votes") >= F.col("yes_votes")),
        F.col("valid_votes") - F.col("yes_votes"),
    )
    return rows.withColumn("no_votes", F.coalesce("no_votes", derived))


def _first_known(measure: str) -> Column:
    return F.min_by(measure, F.when(F.col(measure).isNotNull(), F.col("order"))).alias(measure)


def _share() -> Column:
    nothing = F.lit(0).cast("bigint")
    return percentage(
        F.col("votes"),
        F.coalesce(
            F.nullif(F.col("valid_list_votes"), nothing), F.nullif(F.col("valid_votes"), nothing)
        ),
    )


_CONTEXT = ("context_hash", "context_key")


#: Bits of the filter of contexts to fill: one megabyte, however many contexts there are.
_FILTER_BITS = 1 << 23
_CARRIED = (*MEASURES, "turnout_percentage")


def _with_context_key(rows: DataFrame) -> DataFrame:
    # One struct instead of eleven columns: structs compare NULL fields as equal,
    # and a single join key keeps the optimiser's inferred constraints few.
    # The hash goes first, so that sorting for the join seldom compares structs.
    keys = (*ARCHIVE, *SUMMARY_KEY)
    return rows.withColumns({"context_hash": F.xxhash64(*keys), "context_key": F.struct(*keys)})


def _differing_contexts(hashed: DataFrame) -> DataFrame:
    """(context_hash) of the contexts whose rows do not all publish the same figures.

    Three numbers a row are grouped, no keys: contexts that share a hash only look different.
    """
    known = [F.coalesce(F.col(m).cast("string"), F.lit("")) for m in _CARRIED]
    figures = F.xxhash64(F.concat_ws("|", *known))
    grouped = hashed.select("context_hash", figures.alias("figures")).groupBy("context_hash")
    return grouped.agg(F.min("figures").alias("least"), F.max("figures").alias("most")).where("least <> most").select("context_hash")


def _bit(position: Column) -> tuple[Column, Column]:
    """Bucket and bit of a position, counted from 0, in buckets as ``bitmap_construct_agg`` makes them."""
    size = 1 << 15
    return F.floor(position / size).cast("int"), F.pmod(position, F.lit(size)).cast("int")


def _filter_of(hashes: DataFrame) -> Column:
    """A Bloom filter of one hash, as an array of bitmaps that Spark hands to the tasks with the plan."""
    bucket, bit = _bit(F.pmod("context_hash", F.lit(_FILTER_BITS)))
    built = hashes.select(bucket.alias("bucket"), bit.cast("bigint").alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits")
    )
    one = built.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("m"))
    none = F.lit(b"")
    every = F.transform(F.sequence(F.lit(0), F.lit((_FILTER_BITS >> 15) - 1)), lambda b: F.coalesce(F.try_element_at("m", b), none))
    return one.select(every.alias("filter")).scalar()


def _perhaps_in(bitmaps: Column) -> Column:
    """Whether a row's context may be in the filter; no context in it is missed."""
    bucket, bit = _bit(F.pmod("context_hash", F.lit(_FILTER_BITS)))
    byte = F.conv(F.hex(F.substring(F.get(bitmaps, bucket), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))


def fill_summaries(rows: DataFrame) -> DataFrame:
    """The rows with the first known figures of their context, in row order.

    Where all rows of a context publish the same figures nothing is to be filled,
    and such rows are neither shuffled nor joined: a filter of one megabyte tells
    them from the others. Of the others one row a context is joined on its hash,
    with its key as the second condition, so that rows do not carry their key
    twice. A context with very many rows is split by the adaptive skew-join.
    """
    keys = (*ARCHIVE, *SUMMARY_KEY)
    hashed = rows.withColumn("context_hash", F.xxhash64(*keys))
    differing = stage(_differing_contexts(hashed))
    perhaps = _perhaps_in(_filter_of(differing))
    open_rows = hashed.where(perhaps)
    summaries = stage(
        open_rows.withColumn("context_key", F.struct(*keys)).groupBy(*_CONTEXT).agg(*[_first_known(m) for m in _CARRIED])
        .withColumnRenamed("context_hash", "summary_hash")
    )
    same = (F.col("context_hash") == F.col("summary_hash")) & (F.struct(*keys) == F.col("context_key"))
    filled = open_rows.drop(*_CARRIED).join(summaries, same).drop("summary_hash", "context_key")
    settled = hashed.where(~perhaps)
    return filled.select(*settled.columns).unionByName(settled).drop("context_hash", "yields_result")


def _finish(results: DataFrame) -> DataFrame:
    return (
        results.withColumn("subject_key", slug(F.col("subject")))
        .withColumn("percentage", _share())
        .select(*FACT_COLUMNS)
    )


def aggregate_results(filled: DataFrame) -> DataFrame:
    """Expand filled aggregate rows into one fact per published subject."""
    valid = F.when(
        F.col("category") == "referendum",
        F.coalesce(F.col("valid_votes"), F.col("yes_votes") + F.col("no_votes")),
    ).otherwise(F.col("valid_votes"))
    derived = _derive_no(filled).withColumn("valid_votes", valid)
    exploded = derived.withColumn("spec", F.explode(_specs())).withColumns(
        {c: F.col(f"spec.{c}") for c in ("result_type", "subject", "party", "candidate", "option", "votes")}
    )
    return _finish(
        exploded.withColumn("source_file", F.col("file_name")).withColumn(
            "source_row", F.col("row_number").cast("bigint")
        )
    )


def section_results(rows: DataFrame) -> DataFrame:
    """Sum polling-section rows to municipality facts (row number 0)."""
    sections = _with_context_key(
        rows.where(F.col("section").isNotNull() & ~F.col("not_results"))
    )
    known = sections.groupBy(*_CONTEXT, "section").agg(*[_first_known(m) for m in MEASURES])
    totals = known.groupBy(*_CONTEXT).agg(*[F.sum(m).alias(m) for m in MEASURES])

    expanded = _derive_no(sections).withColumn("spec", F.explode(_specs()))
    grouped = (
        expanded.withColumns(
            {
                c: F.col(f"spec.{c}")
                for c in ("result_type", "subject", "party", "candidate", "option", "votes")
            }
        )
        .withColumn("subject_slug", slug(F.col("subject")))
        .groupBy(*_CONTEXT, "result_type", "subject_slug", "candidate", "option")
        .agg(
            F.sum("votes").alias("votes"),
            F.min_by(
                F.struct("municipality", "question", "subject", "party", "seats", "file_name"), "order"
            ).alias("first"),
        )
    )
    lists = (
        grouped.where(F.col("result_type") == "list")
        .groupBy(*_CONTEXT)
        .agg(F.sum("votes").alias("list_votes"))
    )
    figures = (
        totals.join(lists, list(_CONTEXT), "left")
        .withColumn("valid_list_votes", F.coalesce("valid_list_votes", "list_votes"))
        .withColumn("turnout_percentage", percentage(F.col("voters"), F.col("electors")))
        .drop("list_votes")
    )
    joined = grouped.join(figures, list(_CONTEXT)).select("*", "context_key.*")
    return _finish(
        joined.withColumns(
            {c: F.col(f"first.{c}") for c in ("municipality", "question", "subject", "party", "seats")}
        )
        .withColumn("source_file", F.concat(F.col("first.file_name"), F.lit("#municipality-aggregate")))
        .withColumn("source_row", F.lit(0).cast("bigint"))
    )


def normalise(raw: DataFrame) -> DataFrame:
    """Facts of every archive; section rows serve archives without aggregate results.

    The resolved rows serve the summaries, the results and the section path, so
    they are staged once instead of parsing the payload three times.
    """
    with in_compiled_methods(raw.sparkSession):
        rows = stage(read_columns(raw).withColumn("yields_result", _yields_result()))
    usable = rows.where(~F.col("not_aggregate") & F.col("section").isNull())
    served = usable.groupBy(*ARCHIVE).agg(F.max("yields_result").alias("served")).where("served")
    unserved = rows.join(served.select(*ARCHIVE), list(ARCHIVE), "left_anti")
    return aggregate_results(fill_summaries(usable)).unionByName(section_results(unserved))


def municipal_only(raw: DataFrame) -> DataFrame:
    """The older municipal reading: the first vote column present decides."""

    def first_present(names: tuple[str, ...]) -> Column:
        column = F.when(F.lit(False), F.lit(None).cast("bigint"))
        for n in names:
            column = column.when(
                F.map_contains_key("payload", n),
                as_int(F.try_element_at("payload", F.lit(n)), F.try_element_at("numbers", F.lit(n))),
            )
        return column

    names = fv.MUNICIPAL_ONLY
    surname, name = first_text(*fv.SUBJECTS["surname"]), first_text(*fv.SUBJECTS["name"])
    read = raw.where(_given("municipality").isNotNull()).select(
        *ARCHIVE, "region", "province", "municipality",
        F.coalesce(_given("municipality_key"), slug(F.col("municipality"))).alias("municipality_key"),
        first_text(*names["party"]).alias("party"),
        first_present(names["votes"]).alias("votes"),
        as_int(F.try_element_at("payload", F.lit("turno")), F.try_element_at("numbers", F.lit("turno"))).alias("round"),
        F.nullif(F.concat_ws(" ", surname, name), F.lit("")).alias("candidate"),
        first_present(names["seats"]).alias("seats"),
        F.col("file_name").alias("source_file"),
        F.col("row_number").cast("bigint").alias("source_row"),
    )
    return read.where(F.col("party").isNotNull() & F.col("votes").isNotNull()).withColumn(
        "party_key", slug(F.col("party"))
    )
