"""Url parts and canonical urls as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import strip

# Query keys that only track where a reader came from.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "ref", "source")

# RFC 3986, appendix B, with the ``;parameters`` of the last path segment as a part of their own.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*?)(;[^/?#]*)?(?:\?([^#]*))?(?:#(.*))?$"


def domain_of(url: Column) -> Column:
    """Authority of a url (port and user part kept), or the empty string."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.coalesce(strip(authority), F.lit(""))


def _decode(text: Column) -> Column:
    # A percent sign that starts no escape stands for itself, beside good escapes too.
    escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(escaped), plain)


def _encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_query(query: Column, tracking_keys: Sequence[str] = TRACKING_KEYS) -> Column:
    """Query string without tracking keys and AMP switches; order and blank values are kept."""

    def key(pair: Column) -> Column:
        return _decode(F.substring_index(pair, "=", 1))

    def value(pair: Column) -> Column:
        has_value = F.instr(pair, "=") > 0
        return F.when(has_value, _decode(F.regexp_replace(pair, "^[^=]*=", ""))).otherwise("")

    def keep(pair: Column) -> Column:
        name = F.lower(key(pair))
        amp = (name == "amp") & F.lower(value(pair)).isin("1", "true")
        return (pair != "") & ~name.isin(*tracking_keys) & ~amp

    def encode(pair: Column) -> Column:
        return F.concat(_encode(key(pair)), F.lit("="), _encode(value(pair)))

    pairs = F.transform(F.filter(F.split(query, "&"), keep), encode)
    return F.when(query == "", F.lit("")).otherwise(F.array_join(pairs, "&"))


def clean_url(url: Column, tracking_keys: Sequence[str] = TRACKING_KEYS) -> Column:
    """Canonical form of a url: no AMP path, no tracking keys; NULL and blank stay as they are."""
    text = strip(url)

    def part(group: int) -> Column:
        return F.regexp_extract(text, _URL, group)

    path = part(3)
    plain = F.regexp_replace(path, r"/amp/?$", "")
    path = F.when((plain == "") & (path != ""), F.lit("/")).otherwise(plain)
    query = clean_query(part(5), tracking_keys)
    scheme = F.lower(part(1))

    def prefixed(prefix: str, value: Column) -> Column:
        return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(prefix), value))

    rebuilt = F.concat(
        F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
        part(2), path, part(4), prefixed("?", query), prefixed("#", part(6)),
    )
    return F.when(text == "", url).otherwise(rebuilt)
