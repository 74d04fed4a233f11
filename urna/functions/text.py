"""Text columns: cleaning, search keys and place-name canonicalisation.

Everything here is a JVM expression.  Search keys need Unicode folding, which
Spark lacks; the folding tables are generated once from ``unicodedata`` and
enter the plan as literals.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from urna import fixed_values as fv

_BLANKS = r"[\s\x1c-\x1f\p{IsWhite_Space}]+"


def let(value: Column, body) -> Column:
    """Bind a costly expression once; a plain reuse would copy it into the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(value: Column) -> Column:
    """Collapse runs of Unicode white space and trim; NULL stays NULL."""
    return F.trim(F.regexp_replace(value, _BLANKS, " "))


def present(value: Column) -> Column:
    """The cleaned text, or NULL where nothing was published."""
    return let(clean_text(value), lambda text: F.nullif(text, F.lit("")))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str, dict[str, str]]:
    """Character folds as (one-to-one source, target, deleted, one-to-many)."""
    source, target, deleted, wide = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        decomposed = unicodedata.normalize("NFKD", char)
        kept = "".join(c for c in decomposed if not unicodedata.combining(c))
        folded = re.sub(r"[^a-z0-9]+", "_", kept.casefold())
        if kept == "":
            deleted.append(char)
        elif folded == "_":
            continue
        elif len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            wide[char] = folded
    return "".join(source), "".join(target), "".join(deleted), wide


def _ranges(chars) -> str:
    """A pattern's class of the characters, neighbours as ranges: a class is tried part by part."""
    parts = []
    for code in sorted(map(ord, chars)):
        if parts and parts[-1][1] == code - 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in parts) + "]"


def slug(value: Column) -> Column:
    """Search key: accents dropped, case folded, other characters become ``_``."""
    source, target, deleted, wide = _folds()
    # One character may stand for several (ß, ﬁ, ½, Ⅳ): rare, so handled by a
    # per-character lookup that only runs on text containing one of them.
    lookup = F.str_to_map(
        F.lit(",".join(f"{char}={spelling}" for char, spelling in wide.items())),
        F.lit(","), F.lit("="),
    )
    # No ASCII character is looked up in the class.
    wide_pattern = r"(?=[^\x00-\x7f])" + _ranges(wide)

    def ascii_only(text: Column) -> Column:
        # Equal byte and character counts mean ASCII: the common, cheap case.
        return F.octet_length(text) == F.length(text)

    def spell_out(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r"(?s)([\x00-\x7f]+|.)"), F.lit(1))
        spelled = F.transform(
            pieces, lambda c: F.when(ascii_only(c), c).otherwise(F.coalesce(F.try_element_at(lookup, c), c))
        )
        return (
            F.when(ascii_only(text), text).when(text.rlike(wide_pattern), F.array_join(spelled, "")).otherwise(text)
        )

    def fold(text: Column) -> Column:
        narrow = F.translate(text, source + deleted, target)
        return F.when(ascii_only(text), text).otherwise(let(narrow, spell_out))

    words = F.regexp_replace(F.lower(let(value, fold)), "[^a-z0-9]+", "_")
    return F.trim(words, F.lit("_"))


def text_key(text: str) -> str:
    """The search key of one Python string: a filter value or a header cell.

    As a literal it can be pushed into a scan, which the column form cannot.
    """
    kept = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "_", "".join(kept).casefold()).strip("_")


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z only, as an ASCII-only case-insensitive comparison needs."""
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def same_nocase(left: Column, right: Column) -> Column:
    return ascii_lower(left) == ascii_lower(right)


def canonical_municipality(value: Column) -> Column:
    """Map the published label of a city's part to the city; else the clean label."""
    cities = "|".join(re.escape(c.lower()).replace("\\ ", " ") for c in fv.SPLIT_CITIES)
    suffixes = "|".join(fv.PART_SUFFIXES)
    aliases = "|".join(fv.CITY_ALIASES)
    # Group 1: an alternative name; 2: "part of the municipality of X"; 3: a split city.
    pattern = (
        rf"^(?:({aliases})|{fv.PART_OF_CITY}"
        rf"|({cities})(?:(?:{suffixes}).*|\s+\p{{Nd}}+|\s+[ivxlcdm]+))$"
    )

    def official(name: Column) -> Column:
        for published, kept in fv.CITY_ALIASES.items():
            name = F.when(name == published.upper(), F.lit(kept)).otherwise(name)
        return name

    def resolve(label: Column) -> Column:
        city = F.upper(F.trim(F.regexp_replace(F.lower(label), pattern, "$1$2$3")))
        return (
            F.when(label == "", F.lit(None))
            .when(F.lower(label).rlike(pattern), let(city, official))
            .otherwise(label)
        )

    return let(clean_text(value), resolve)


def geography_key(
    municipality: Column, province: Column, region: Column, constituency: Column
) -> Column:
    """Key a place by the most specific geography published with it."""
    return place_key(slug(municipality), province, region, constituency)


def place_key(
    municipality_key: Column, province: Column, region: Column, constituency: Column
) -> Column:
    """As :func:`geography_key`, from a municipality key already computed."""

    def given(value: Column) -> Column:
        return value.isNotNull() & (value != "")

    level = F.when(given(province), "p:").when(given(region), "r:").when(given(constituency), "c:")
    name = F.coalesce(
        F.nullif(province, F.lit("")), F.nullif(region, F.lit("")), F.nullif(constituency, F.lit(""))
    )
    prefix = F.coalesce(F.concat(level, slug(name), F.lit("|")), F.lit(""))
    return F.concat(prefix, municipality_key)


# Scanned names -------------------------------------------------------------


def scan_key(value: Column) -> Column:
    """Collapse the letters a scan confuses, keep A-Z only."""
    confused, read_as = fv.SCAN_CONFUSIONS
    return F.regexp_replace(F.translate(F.upper(value), confused, read_as), "[^A-Z]", "")


def clean_scanned_name(value: Column) -> Column:
    """A printed name without the marks around it.

    Brackets, quotes and stars are blanks, typographic apostrophes plain ones; a
    last word that holds nothing but what a column rule or page number is read as
    goes; marks at either end go.
    """
    around, rule, ends = "(){}[]€<>|*\"“”", "23Iìèî?>.,;:", " .,;:-"
    text = F.translate(F.translate(value, around, " " * len(around)), "’‘`", "'''")
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")
    said = F.transform(words, lambda w: F.translate(w, rule, ""))
    stray = (F.size(words) > 1) & (F.element_at(said, -1) == "")
    kept = F.when(stray, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    return F.btrim(F.array_join(kept, " "), F.lit(ends))


def mostly_upper(value: Column) -> Column:
    """Of five letters more than four are capitals."""
    capitals, letters = (F.regexp_count(value, F.lit(kind)) for kind in (r"\p{Lu}", r"\p{L}"))
    return (letters > 0) & (capitals > 0.8 * letters)


def edit_similarity(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return F.lit(1.0) - F.levenshtein(left, right) / longest
