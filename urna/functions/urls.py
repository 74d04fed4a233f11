"""URL columns: query codes and the host policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urna import fixed_values as fv
from urna.functions.text import let


def query_code(url: Column, name: str) -> Column:
    """One query parameter, decoded; the last one counts if it is repeated."""
    raw = F.regexp_extract(url, rf"^.*[?&]{name}=([^&#]*)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def _decoded(text: Column) -> Column:
    """A query part as meant; one that is no valid encoding stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding with the unreserved characters of RFC 3986."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_entries(url: Column) -> Column:
    """Decoded query parameters as an array of (key, value), a key once: first place, last value."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")
        ),
    )

    def once(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: e["key"])
        last = lambda e: F.element_at(F.filter(all_, lambda o: o["key"] == e["key"]), -1)
        return F.transform(F.filter(all_, lambda e, i: F.array_position(keys, e["key"]) == i + 1), last)

    return let(pairs, once)


def with_query(url: Column, entries: Column, changes: dict[str, Column] | list[tuple[Column, Column]]) -> Column:
    """The URL with its parameters changed in place and new ones added at the end."""
    pairs = [(F.lit(k) if isinstance(k, str) else k, v) for k, v in (changes.items() if isinstance(changes, dict) else changes)]
    new = F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in pairs])

    def joined(own: Column, more: Column) -> Column:
        changed = F.transform(
            own,
            lambda e: F.struct(
                e["key"].alias("key"), F.coalesce(F.get(F.filter(more, lambda n: n["key"] == e["key"]), F.lit(0))["value"], e["value"]).alias("value")
            ),
        )
        added = F.filter(more, lambda n: ~F.exists(own, lambda e: e["key"] == n["key"]))
        return F.array_join(F.transform(F.concat(changed, added), lambda e: F.concat(_encoded(e["key"]), F.lit("="), _encoded(e["value"]))), "&")

    query = let(entries, lambda own: let(new, lambda more: joined(own, more)))
    return F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.lit("?"), query, F.regexp_extract(url, "(#.+)$", 1))


def resolve_url(base: Column, reference: Column) -> Column:
    """A reference read on the page at ``base``, as an absolute URL."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)", 1)).otherwise("/")

    def without_dots(text: Column) -> Column:
        own = F.regexp_extract(text, "^([^?#]*)", 1)
        up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        segments = F.split(own, "/")
        folded = F.aggregate(
            F.concat(F.transform(segments, lambda s: s), F.when(own.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))),
            F.array().cast("array<string>"),
            lambda kept, s: F.when(s == "..", up(kept)).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))),
        )
        return F.when(own.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(folded, "/"), F.regexp_extract(text, "([?#].*)$", 1))).otherwise(text)

    return (
        F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference == "", base)
        .when(reference.startswith("//"), F.concat(scheme, reference))
        .when(reference.startswith("/"), F.concat(origin, without_dots(reference)))
        .when(reference.startswith("?"), F.concat(origin, path, reference))
        .when(reference.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), reference))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, reference))))
    )


def join_url(base: str, reference: Column) -> Column:
    """Resolve a published reference against a directory URL."""
    root = "/".join(base.split("/")[:3])
    return (
        F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference.startswith("//"), F.concat(F.lit("https:"), reference))
        .when(reference.startswith("/"), F.concat(F.lit(root), reference))
        .otherwise(F.concat(F.lit(base), reference))
    )


def url_policy(url: Column) -> Column:
    """``ok`` or the first rule a URL breaks."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    user = F.try_parse_url(url, F.lit("USERINFO"))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    return (
        F.when(scheme.isNull() | (scheme != "https"), "not_https")
        .when(user.isNotNull() & ~user.isin("", ":"), "credentials")
        .when(host.isNull() | ~host.isin(*fv.ALLOWED_HOSTS), "host_not_allowed")
        .when(~port.isin("", "443"), "port_not_allowed")
        .otherwise("ok")
    )
