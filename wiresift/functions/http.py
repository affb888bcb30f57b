"""Parts of HTTP messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name, in any case; null without one."""
    found = F.filter(headers, lambda h: F.lower(F.trim(F.substring_index(h, ":", 1))) == name.lower())
    first = F.get(found, F.lit(0))
    return F.trim(F.substring(first, F.instr(first, ":") + 1, F.length(first)))


def content_type(headers: Column) -> Column:
    """Media type: cut at `;`, trimmed, lower-cased."""
    return F.lower(F.trim(F.split_part(header_value(headers, "Content-Type"), F.lit(";"), F.lit(1))))


# Urls in stored traffic need not be well-formed, so their parts are cut by pattern and not by a url parser.
_START = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def path(url: Column) -> Column:
    return F.regexp_extract(url, _START + r"[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """Raw query; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, _START + r"(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit(""))


def port(url: Column) -> Column:
    """Port number, -1 where the url names none."""
    digits = F.regexp_extract(url, _START + r"[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(-1))


def form_decoded(text: Column) -> Column:
    """One form decoding (`+` is a space); the text itself where an escape is malformed."""
    return F.coalesce(F.try_url_decode(text), text)


def decode_chain(text: Column, depth: int) -> Column:
    """[text, decoded once, decoded twice, ...]: at most `depth` decodings, each distinct text once."""

    def deeper(layers: Column, _: Column) -> Column:
        last = F.element_at(layers, -1)
        return F.concat(layers, F.array(F.when(last.contains("%") | last.contains("+"), form_decoded(last)).otherwise(last)))

    # Step by step, as nested decodings would be worked out again and again.
    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(text), deeper))


def pairs(text: Column, separator: str) -> Column:
    """[(name, value)] of `a=b&c=d` text: the first `=` splits; pairs without one have a null value."""

    def one(p: Column) -> Column:
        at = F.instr(p, "=")
        name = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        return F.struct(name.alias("name"), F.when(at > 0, F.substring(p, at + 1, F.length(p))).alias("value"))

    return F.transform(F.filter(F.split(text, separator), lambda p: p != ""), one)
