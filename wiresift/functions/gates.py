"""Gates: which exchanges, bodies, headers and values are looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import http

# Fixed values.
ASSET_PATH = r"\.(js|css|map|woff2?|ttf|otf|eot|svg|ico)$"
OLD_ASSET_PATH = r"\.js$"
BLOCKED_TYPE = (
    r"(?i)^(?:(?:image|video|audio|font)/|text/(?:css|javascript)|application/(?:pdf|octet-stream|x-protobuf|protobuf|"
    r"wasm|zip|gzip|x-gzip|x-7z-compressed|x-rar-compressed|vnd\.|javascript|x-javascript|font-woff2?|x-font-ttf|"
    r"x-font-otf|x-font-woff|font-ttf|font-otf))"
)
ALLOWED_TYPES = ("text/html", "application/json", "text/json", "application/xml", "text/xml", "application/xhtml")
NOISY_HEADERS = ("cookie", "set-cookie", "authorization", "user-agent", "referer", "cache-control", "priority")
NOISY_PREFIXES = ("accept-", "sec-fetch")


def is_asset(url: Column, old: bool = False) -> Column:
    """The path names a static file; false where there is no path."""
    path = F.lower(http.path(url))
    return F.coalesce(path.rlike(OLD_ASSET_PATH if old else ASSET_PATH), F.lit(False))


def is_blocked_type(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(BLOCKED_TYPE), F.lit(False))


def is_allowed_type(content_type: Column) -> Column:
    """Decode job: no type at all, or one of the text types."""
    kind = F.lower(content_type)
    some = F.lit(False)
    for x in ALLOWED_TYPES:
        some = some | kind.contains(x)
    return content_type.isNull() | (content_type == "") | some


def has_body_method(method: Column) -> Column:
    return F.coalesce(F.upper(method).isin("POST", "PUT", "PATCH"), F.lit(False))


def body_fits(body: Column, most: int) -> Column:
    return F.coalesce(F.octet_length(body).between(1, most), F.lit(False))


def is_noisy_header(header: Column) -> Column:
    """Headers that never hold tokens worth decoding, and lines without a colon."""
    name = F.lower(F.trim(F.substring_index(header, ":", 1)))
    noisy = name.isin(*NOISY_HEADERS)
    for p in NOISY_PREFIXES:
        noisy = noisy | name.startswith(p)
    return noisy | (F.instr(header, ":") == 0)


def input_fits(value: Column, least: int, most: int) -> Column:
    """Length bounds of captured inputs in characters; 0 turns a bound off; null never fits."""
    fits = value.isNotNull()
    if least:
        fits = fits & (F.length(value) >= least)
    if most:
        fits = fits & (F.length(value) <= most)
    return fits
