"""Reading the fact table: filters, row projections, ordered pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.text import same_nocase, slug, text_key
from urna.session import stage

RESULT_ORDER = (
    "election_date", "category", "region", "province", "municipality",
    "question_number", "result_type", "subject", "source_file", "source_row",
)
COVERAGE_ORDER = (
    "election_date", "category", "region", "province", "municipality",
    "constituency", "college", "source_file", "round", "question_number",
)
MUNICIPAL_ORDER = (
    "election_date", "region", "province", "municipality", "party", "candidate", "source_row",
)


def _check(name: str, value: str | None, allowed: tuple[str, ...]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of: {', '.join(allowed)}")


def _year_predicate(year: int, column: str = "election_date") -> Column:
    # A range on the stored date prunes partitions and row groups; year(date) would not.
    return F.col(column).between(F.lit(dt.date(year, 1, 1)), F.lit(dt.date(year, 12, 31)))


def filter_results(
    facts: DataFrame,
    *,
    category: str | None = None,
    year: int | None = None,
    election_date: dt.date | None = None,
    region: str | None = None,
    province: str | None = None,
    municipality: str | None = None,
    result_type: str | None = None,
    subject: str | None = None,
    round_number: int | None = None,
) -> DataFrame:
    """Keep the result rows that meet every given condition."""
    out = facts
    if category:
        out = out.where(F.col("category") == category)
    if year is not None:
        out = out.where(_year_predicate(year))
    if election_date is not None:
        out = out.where(F.col("election_date") == F.lit(election_date))
    if region:
        out = out.where(same_nocase(F.col("region"), F.lit(region)))
    if province:
        out = out.where(same_nocase(F.col("province"), F.lit(province)))
    if municipality:
        out = out.where(F.col("municipality_key") == text_key(municipality))
    if result_type:
        out = out.where(F.col("result_type") == result_type)
    if subject:
        out = out.where(F.col("subject_key") == text_key(subject))
    if round_number is not None:
        out = out.where(F.col("round") == round_number)
    return out


def filter_national(facts: DataFrame, *, category: str | None = None, **conditions) -> DataFrame:
    """As :func:`filter_results`, over the five national categories only."""
    _check("category", category, fv.NATIONAL_CATEGORIES)
    national = facts.where(F.col("category").isin(*fv.NATIONAL_CATEGORIES))
    return filter_results(national, category=category, **conditions)


def filter_municipal(
    facts: DataFrame,
    *,
    year: int | None = None,
    election_date: dt.date | None = None,
    municipality: str | None = None,
    province: str | None = None,
    party: str | None = None,
    round_number: int | None = 1,
) -> DataFrame:
    """Municipal party rows; round 1 also keeps rows that carry no round."""
    out = municipal_rows(facts)
    out = filter_results(
        out, year=year, election_date=election_date, municipality=municipality, province=province
    )
    if party:
        out = out.where(F.col("subject_key") == text_key(party))
    if round_number == 1:
        out = out.where((F.col("round") == 1) | F.col("round").isNull())
    elif round_number is not None:
        out = out.where(F.col("round") == round_number)
    return out


def municipal_rows(facts: DataFrame) -> DataFrame:
    """The municipal party projection, read from the fact table itself."""
    return facts.where(
        (F.col("category") == "comunali")
        & (F.col("result_type") == "list")
        & (F.col("municipality") != "")
        & (F.col("party") != "")
    )


def filter_raw(
    raw: DataFrame,
    *,
    category: str,
    election_date: dt.date,
    municipality: str | None = None,
    province: str | None = None,
) -> DataFrame:
    """Raw rows of one archive, payload kept, provenance in ``_meta``."""
    out = raw.where((F.col("category") == category) & (F.col("election_date") == F.lit(election_date)))
    if municipality:
        out = out.where(F.col("municipality_key") == text_key(municipality))
    if province:
        out = out.where(same_nocase(F.col("province"), F.lit(province)))
    return raw_with_provenance(out)


def raw_with_provenance(raw: DataFrame) -> DataFrame:
    return raw.select(
        "payload",
        F.struct("category", "election_date", "file_name", "row_number").alias("_meta"),
    )


def in_scope(
    rows: DataFrame,
    *,
    province: str | None = None,
    region: str | None = None,
    constituency: str | None = None,
) -> DataFrame:
    """Geography scope: province, else region; a constituency widens the match."""
    conditions = []
    if province:
        conditions.append(same_nocase(F.col("province"), F.lit(province)))
    elif region:
        conditions.append(same_nocase(F.col("region"), F.lit(region)))
    if constituency:
        conditions.append(same_nocase(F.col("constituency"), F.lit(constituency)))
    if not conditions:
        return rows
    wanted = conditions[0]
    for more in conditions[1:]:
        wanted = wanted | more
    return rows.where(wanted)


def with_archive(facts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add download address and digest of the archive each row came from.

    An election may have several archives, so the archive itself is the key.
    """
    return facts.join(catalogue.select("archive", "download_url", "sha256"), "archive")


def result_rows(facts: DataFrame, *carried: str) -> DataFrame:
    """Published row shape: location key, location status and output names.

    Expects the rows of :func:`with_archive`; ``carried`` columns pass through.
    """
    named = F.col("municipality").isNotNull()
    located = F.when(~named, "non_municipal").otherwise(
        F.when(
            (F.col("province") != "") & (F.col("region") != ""), "region_province_municipality"
        )
        .when(F.col("province") != "", "province_municipality")
        .when(F.col("region") != "", "region_municipality_incomplete")
        .otherwise("municipality_incomplete")
    )
    key = F.when(
        (F.col("municipality") != "") & (F.col("province") != ""),
        F.concat_ws(
            "|",
            F.col("election_date").cast("string"),
            slug(F.col("province")),
            slug(F.col("municipality")),
        ),
    )
    sources = {
        "tipo_elezione": "category", "data": "election_date", "turno": "round",
        "regione": "region", "circoscrizione": "constituency", "provincia": "province",
        "comune": "municipality", "nazione": "country", "collegio": "college",
        "numero_quesito": "question_number", "quesito": "question",
        "tipo_risultato": "result_type", "soggetto": "subject", "partito": "party",
        "candidato": "candidate", "opzione_referendum": "option", "voti": "votes",
        "percentuale": "percentage", "seggi": "seats", "elettori": "electors",
        "elettori_maschi": "male_electors", "votanti": "voters",
        "votanti_maschi": "male_voters", "affluenza_pct": "turnout_percentage",
        "voti_validi": "valid_votes", "voti_validi_liste": "valid_list_votes",
        "voti_validi_candidato": "valid_candidate_votes", "schede_bianche": "blank_ballots",
        "schede_non_valide": "invalid_ballots", "schede_contestate": "contested_ballots",
        "fonte_url": "download_url", "fonte_file": "source_file", "fonte_riga": "source_row",
        "sha256": "sha256",
    }
    columns = {out: F.col(name) for out, name in sources.items()}
    columns["chiave_comune_tornata"] = key
    columns["stato_localizzazione"] = located
    return facts.select(*[columns[name].alias(name) for name in fv.RESULT_COLUMNS], *carried)


def municipal_output(rows: DataFrame) -> DataFrame:
    sources = (
        "election_date", "region", "province", "municipality", "party", "votes", "round",
        "candidate", "seats", "source_file", "source_row",
    )
    return rows.select(*[F.col(s).alias(o) for s, o in zip(sources, fv.MUNICIPAL_COLUMNS)])


def ordered(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """Total order, NULLs first; a column given as such keeps its own direction."""
    return df.orderBy(*[F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order])


def page(df: DataFrame, order: tuple[str, ...], *, limit: int = 1000, offset: int = 0) -> DataFrame:
    """One ordered page (at most 5,000 rows): a top-k, never a full sort.

    Every task keeps offset + limit rows; for deep pages see :func:`numbered_page`.
    """
    if not 1 <= limit <= 5000 or offset < 0:
        raise ValueError("limit must lie between 1 and 5000 and offset must not be negative")
    return ordered(df, order).offset(offset).limit(limit)


def numbered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Every row with its ``position`` in the order, from 1.

    A range sort is written once; a row's position is its place in its range plus the
    rows of all earlier ranges, so no task holds more than its own range.
    """
    place = F.monotonically_increasing_id()
    written = stage(ordered(df, order).withColumn("_place", place))
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a range: as many as the sort has tasks.
    counts = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    return written.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "position", F.col("_before") + at + 1
    ).drop("_place", "_part", "_before")


def numbered_page(df: DataFrame, order: tuple[str, ...], *, limit: int = 1000, offset: int = 0) -> DataFrame:
    """:func:`page` at any depth: the rows at positions offset + 1 to offset + limit, with them."""
    if not 1 <= limit <= 5000 or offset < 0:
        raise ValueError("limit must lie between 1 and 5000 and offset must not be negative")
    return numbered(df, order).where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def page_after(df: DataFrame, order: tuple[str, ...], last: dict, *, limit: int = 1000) -> DataFrame:
    """Keyset page: the rows that follow ``last`` in the order.

    Deep pages cost the same as the first one, which an offset cannot offer.
    """
    after = F.lit(False)
    for column in reversed(order):
        value = last[column]
        if value is None:
            later, equal = F.col(column).isNotNull(), F.col(column).isNull()
        else:
            later, equal = F.col(column) > F.lit(value), F.col(column).eqNullSafe(F.lit(value))
        after = F.coalesce(later, F.lit(False)) | (equal & after)
    return page(df.where(after), order, limit=limit)


def total(df: DataFrame) -> DataFrame:
    """Number of rows behind a page, as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("total"))
