"""Finding and decoding opaque tokens in text surfaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codecs, gates, http, quality, routes
from ..options import OLDER_DECODE, DecodeOptions

#: What a hit adds to its surface.
HIT = StructType().add("token", "string").add("whole", "boolean").add("layer", "integer").add("route", "string").add("decoded", "string")

URI_SAFE_CLASS = r"[^A-Za-z0-9+\-$_.]"
BASE64_CLASS = r"[A-Za-z0-9_\-+/=]"
TOKEN_CLASS = r"[A-Za-z0-9_\-+$/=.]"
OLDER_TOKEN_CLASS = r"[A-Za-z0-9_\-+$]"
BASE64_TOKEN = r"^[A-Za-z0-9_\-+/]*=*$"


#: A scope of up to so many rows is sent to all tasks.
SMALL_SCOPE = 100_000


def in_scope(exchanges: DataFrame, scope: DataFrame) -> DataFrame:
    """Exchanges whose host and path prefix stand in `scope` (host, path_prefix); each row once."""
    scope = scope.select("host", "path_prefix").distinct()
    if scope.limit(SMALL_SCOPE + 1).count() <= SMALL_SCOPE:
        scope = F.broadcast(scope)
    rows = exchanges.withColumns({"_host": http.host(F.col("url")), "_path": F.coalesce(http.path(F.col("url")), F.lit(""))})
    inside = (rows["_host"] == scope["host"]) & F.startswith(rows["_path"], scope["path_prefix"])
    return rows.join(scope, inside, "left_semi").drop("_host", "_path")


def candidate_tokens(text: Column, least: int = 8, older: bool = False) -> Column:
    """Maximal runs of token characters of at least so many, in order."""
    return F.regexp_extract_all(text, F.lit(f"{OLDER_TOKEN_CLASS if older else TOKEN_CLASS}{{{least},}}"), F.lit(0))


def looks_uri_safe(text: Column, options: DecodeOptions = DecodeOptions()) -> Column:
    share = F.try_divide(F.length(F.regexp_replace(text, URI_SAFE_CLASS, "")), F.length(text))
    return (F.length(text) >= options.min_token) & (share >= (0.95 if options.strict else 0.85))


def looks_base64(text: Column, least: int = 8) -> Column:
    return text.rlike(BASE64_TOKEN) & (F.length(text) >= least)


def base64_shape(text: Column, options: DecodeOptions) -> Column:
    return text.rlike(f"^{BASE64_CLASS}{{{options.min_base64},}}$")


def base64_normal(text: Column) -> Column:
    """The plain alphabet, padded to a multiple of four."""
    plain = F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")


def lz_padded(text: Column) -> Column:
    """Padded as LZ-String pads: up to three =, and left-over bits that strict Base64 forbids."""
    return text.rlike(BASE64_TOKEN) & text.endswith("=") & (F.length(text) % 4 == 0)


def base64_bytes(text: Column, options: DecodeOptions = DecodeOptions()) -> Column:
    """Decoded bytes, where they encode to the same text again, or the padded text reads well; else null."""
    normal = base64_normal(text)
    data = F.try_to_binary(normal, F.lit("base64"))
    again = F.replace(F.replace(F.base64(data), F.lit("\r\n"), F.lit("")), F.lit("="), F.lit(""))
    padded = F.contains(text, F.lit("=")) & quality.passes(utf8(data), options)
    return F.when((again == F.replace(normal, F.lit("="), F.lit(""))) | padded, data)


def utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def hex_text(text: Column) -> Column:
    tight = F.regexp_replace(text, r"\s", "")
    even = (F.length(tight) % 2 == 0) & tight.rlike("^[0-9A-Fa-f]+$")
    return utf8(F.try_to_binary(F.when(even, tight), F.lit("hex")))


def when_accepted(text: Column, options: DecodeOptions) -> Column:
    return F.when(quality.accepted(text, options), text)


def _attempt(route: str, text: Column) -> Column:
    return F.struct(F.lit(route).alias("route"), text.alias("decoded"))


def with_routes(tokens: DataFrame, options: DecodeOptions = DecodeOptions(), every: bool = False) -> DataFrame:
    """`tokens` (token, ...) and what each decode route makes of them, as columns.

    Helpers see only the tokens that the built-in class tests let through; the UTF-16 one
    sees those that the cascade asks it for, or with `every` all.  The older routes
    know LZ-String alone.
    """
    token, cap = F.col("token"), options.max_decoded
    uri = looks_uri_safe(token, options)
    shape = base64_shape(token, options)
    wide = ~(uri | shape) if options.older_routes else looks_base64(token, options.min_token) | ~(uri | shape)
    wide = F.lit(True) if every else wide
    rows = tokens.withColumns(
        {
            "_uri": F.when(uri, codecs.lz_read_udf("uri", cap)(F.when(uri, token))),
            "_data": F.when(shape, base64_bytes(token, options)),
            "_lz": F.when(shape, codecs.lz_read_udf("base64", cap)(F.when(shape, base64_normal(token)))),
            "_utf16": F.when(wide, codecs.lz_decode_udf("utf16", cap)(F.when(wide, token))) if options.try_utf16 else F.lit(None).cast("string"),
        }
    )
    # An LZ-String that doesn't fill its run is none: it is no reading, and keeps no other route from the token.
    any_end = F.lit(not options.full_streams)
    rows = rows.withColumns({c: F.when(any_end | F.col(f"{c}.fills"), F.col(f"{c}.text")) for c in ("_uri", "_lz")})
    if options.older_routes:
        return rows.withColumn("_found", _attempt("lz-base64", F.col("_lz")))
    text = utf8(F.col("_data"))
    rows = rows.withColumn("_text", F.when(quality.passes(text, options), text))
    # Only bytes that are neither an LZ-String nor text are worth the decompressors; malformed text, which stored pieces look like, is asked too.
    malformed = ~F.is_valid_utf8(F.col("_data").cast("string")) & F.lit(options.full_streams)
    none = F.coalesce("_text", F.lit("")).eqNullSafe("") | malformed
    packed = F.when(F.coalesce(F.col("_lz"), F.lit("")).eqNullSafe("") & none, F.col("_data"))
    rows = rows.withColumn("_packed", packed)
    rows = rows.withColumns({f"_{c}": utf8(codecs.decompress_udf(c, cap + codecs.BEYOND, options.full_streams)(F.col("_packed"))) for c in codecs.CODECS})
    # Base64: LZ-String first, whatever its quality; then text; then the decompressors' first accepted result.
    tries = F.array(*[_attempt(c, F.col(f"_{c}")) for c in codecs.CODECS])
    first = first_accepted(tries, options)
    unpacked = F.coalesce(*[F.col(f"_{c}") for c in codecs.CODECS]).isNotNull()
    found = (
        F.when(F.col("_data").isNull() & ~lz_padded(token), F.lit(None))
        .when(F.length("_lz") > 0, _attempt("lz-base64", F.col("_lz")))
        .when((F.length("_text") > 0) & ~(malformed & unpacked), _attempt("base64", F.col("_text")))
        .otherwise(first)
    )
    return rows.withColumn("_found", found)


def first_accepted(attempts: Column, options: DecodeOptions) -> Column:
    return F.get(F.filter(attempts, lambda a: quality.accepted(a["decoded"], options)), F.lit(0))


def tokens_of(surfaces: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """`surfaces` and rank, token, whole, layer: whole layers that look URI-safe first, then tokens by layer and place."""
    rows = placed_tokens(surfaces, options)
    return rows.select(*surfaces.columns, "rank", "token", (F.col("place") % 2 == 1).alias("whole"), F.floor(F.col("place") / 2).cast("int").alias("layer"))


def placed_tokens(surfaces: DataFrame, options: DecodeOptions) -> DataFrame:
    """`surfaces` and rank, token, place; place is twice the layer, and one more for whole layers."""

    def whole(layer: Column, i: Column) -> Column:
        return F.filter(F.array(F.struct(layer.alias("token"), (2 * i + 1).alias("place"))), lambda p: looks_uri_safe(p["token"], options))

    def cut(layer: Column, i: Column) -> Column:
        found = candidate_tokens(layer, options.min_token, options.older_routes)
        return F.transform(found, lambda x: F.struct(x.alias("token"), (2 * i).alias("place")))

    def both(layers: Column) -> Column:
        return F.concat(F.flatten(F.transform(layers, whole)), F.flatten(F.transform(layers, cut)))

    # As the one element of a list, the layers are worked out once for both.
    found = F.get(F.transform(F.array(http.decode_chain(F.col("text"), options.depth)), both), F.lit(0))
    return surfaces.select(*surfaces.columns, F.posexplode(found).alias("rank", "t")).select(*surfaces.columns, "rank", "t.token", "t.place")


READ = "token string, whole boolean, route string, decoded string"


def decoded_tokens(tokens: DataFrame, options: DecodeOptions = DecodeOptions(), unread: bool = False) -> DataFrame:
    """(token, whole, route, decoded) of distinct tokens that the cascade reads; with `unread` of the others too, without route and text."""
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.string())

    def run(batches):
        reader = routes.reader(options)
        for b in batches:
            keys = list(zip(b.column("token").to_pylist(), b.column("whole").to_pylist()))
            found = reader.read(keys)
            rows = [(*k, *(found[k] or (None, None))) for k in keys if unread or found[k] is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["token", "whole", "route", "decoded"])

    return tokens.select("token", "whole").where("token IS NOT NULL").distinct().mapInArrow(run, READ)


def route_readings(tokens: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """(token_id, route, decoded) of tokens (token_id, token, uri) that one route alone reads: the URI-safe one where `uri`, else the Base64 one.

    One Arrow stage, a slice of a batch at a time; the rules are with_routes()'s.
    """

    def run(b):
        reader = routes.reader(options)
        ids, texts, uri = (b.column(c).to_pylist() for c in ("token_id", "token", "uri"))
        found = {True: reader.uri_readings(t for t, u in zip(texts, uri) if u), False: reader.base64_readings(t for t, u in zip(texts, uri) if not u)}
        rows = [(i, *found[u][t]) for i, t, u in zip(ids, texts, uri) if t in found[u]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["token_id", "route", "decoded"])

    rows = tokens.where("token IS NOT NULL").select("token_id", "token", "uri")
    return codecs.in_slices(rows, run, "token_id string, route string, decoded string")


def first_hits(surfaces: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """The first accepted token of every surface: `surfaces`' columns but the text, token, whole, layer, route, decoded.

    A surface's tokens follow one another, so one pass over them in order ends it: nothing is
    shuffled or grouped, and a stream is read like a table.  Only a surface's first token
    carries the surface's columns along.
    """
    keep = [c for c in surfaces.columns if c != "text"]
    head = F.when(F.col("rank") == 0, F.struct(*keep)).alias("head")
    rows = placed_tokens(surfaces, options).select(head, "token", "place")
    out = StructType([*[f for f in surfaces.schema if f.name in keep], *HIT])

    def run(batches):
        reader, last, ended = routes.reader(options), None, True
        for b in batches:
            heads, tokens, places = b.column("head"), b.column("token").to_pylist(), b.column("place").to_pylist()
            starts = np.flatnonzero(heads.is_valid().to_numpy(zero_copy_only=False))
            keys = [(t, p % 2 == 1) for t, p in zip(tokens, places)]
            found = reader.read(keys)
            accepted = np.flatnonzero([found[k] is not None for k in keys])
            # Which surface a hit belongs to: -1 is the one that began in an earlier batch.
            owner = np.searchsorted(starts, accepted, side="right") - 1
            owner, first = np.unique(owner, return_index=True)
            hits = accepted[first]
            if len(owner) and owner[0] < 0 and ended:
                owner, hits = owner[1:], hits[1:]
            of = [last if o < 0 else heads.slice(starts[o], 1) for o in owner]
            if len(starts):
                last, ended = heads.slice(starts[-1], 1), len(owner) > 0 and owner[-1] == len(starts) - 1
            else:
                ended = ended or len(owner) > 0
            if len(hits):
                surfaces_of = pa.concat_arrays(of).flatten()
                made = [(tokens[h], places[h] % 2 == 1, places[h] // 2, *found[keys[h]]) for h in hits]
                columns = [pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*surfaces_of, *columns], names=[*keep, *[f.name for f in HIT]])

    return rows.mapInArrow(run, out)


def records(hits: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Result rows (DECODED): one for each exchange, origin, token and decoded text."""
    url = F.col("url")
    origin = F.concat(F.col("location"), F.when(F.col("whole"), F.lit("-EU-fast")).otherwise(F.lit("")))
    if options.layer_tags:
        origin = F.concat(origin, F.when(F.col("layer") > 0, F.concat(F.lit("-dec"), F.col("layer").cast("string"))).otherwise(F.lit("")))
    rows = hits.select(
        "exchange_id", "ts", "direction", F.coalesce(http.host(url), F.lit("")).alias("host"), http.port(url).alias("port"), "tool",
        origin.alias("origin"), F.length("token").alias("token_len"), "token", "route", "decoded",
    )
    return rows.dropDuplicates(["exchange_id", "origin", "token", "decoded"])


def preview(text: Column) -> Column:
    return F.when(F.length(text) > 50, F.concat(F.left(text, F.lit(47)), F.lit("..."))).otherwise(text)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def issues(rows: DataFrame) -> DataFrame:
    """Result rows as issues with an escaped detail."""
    detail = F.concat(
        F.lit("Origin: "), escaped(F.col("origin")), F.lit("<br>Token: <b>"), escaped(F.col("token")),
        F.lit("</b><br>Decoded: "), escaped(F.col("decoded")),
    )
    return rows.select("exchange_id", "host", F.lit("Certain").alias("confidence"), F.lit("Information").alias("severity"), detail.alias("detail"))


def variants(tokens: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Every accepted route of each token (token_id, variant, value); one `No decode` row where there is none."""
    text = {
        "URL-decoded": F.when(http.form_decoded(F.col("token")) != F.col("token"), http.form_decoded(F.col("token"))),
        "LZ-URI": F.col("_uri"),
        "LZ-Base64": F.col("_lz"),
        "LZ-UTF16": F.col("_utf16"),
        "Base64 text": F.col("_text"),
        **{f"Base64 {c}": F.col(f"_all_{c}") for c in codecs.CODECS},
        "HEX": hex_text(F.col("token")),
        "Base32": utf8(codecs.bytes_udf(codecs.base32_bytes)(F.when(F.col("token").rlike("^[A-Za-z2-7]+=*$"), F.col("token")))),
        "Quoted-Printable": F.when(F.contains("token", F.lit("=")), utf8(codecs.bytes_udf(codecs.quoted_printable_bytes)(F.col("token")))),
    }
    rows = with_routes(tokens, options, every=True)
    cap = options.max_decoded + codecs.BEYOND
    rows = rows.withColumns({f"_all_{c}": utf8(codecs.decompress_udf(c, cap, options.full_streams)(F.col("_data"))) for c in codecs.CODECS})
    rows = rows.withColumns({f"_v{i}": t for i, t in enumerate(text.values())})
    tries = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_v{i}").alias("value")) for i, n in enumerate(text)])
    good = F.filter(tries, lambda a: quality.accepted(a["value"], options))
    rows = rows.select("token_id", F.explode_outer(good).alias("a"))
    return rows.select("token_id", F.coalesce("a.variant", F.lit("No decode")).alias("variant"), F.coalesce("a.value", F.lit("")).alias("value"))


def first_readings(tokens: DataFrame, options: DecodeOptions = OLDER_DECODE) -> DataFrame:
    """The older report on tokens (token_id, token), blanks around them ignored: one row each (token_id, route, value).

    The first accepted of URI-safe and Base64, else what UTF-16 makes of it, whatever
    its quality; `No decode` where that is nothing.  All routes see every token.
    """
    rows = tokens.select("token_id", F.trim("token").alias("_t"))
    made = {
        "lz-uri": codecs.lz_decode_udf("uri", options.max_decoded)(F.col("_t")),
        "lz-base64": codecs.lz_decode_udf("base64", options.max_decoded)(base64_normal(F.col("_t"))),
        "lz-utf16": codecs.lz_decode_udf("utf16", options.max_decoded)(F.col("_t")),
    }
    rows = rows.withColumns({f"_v{i}": v for i, v in enumerate(made.values())})
    uri, b64, wide = (_attempt(r, F.col(f"_v{i}")) for i, r in enumerate(made))
    last = F.when(F.col("_v2").isNotNull(), wide).otherwise(_attempt("No decode", F.lit("")))
    found = F.coalesce(first_accepted(F.array(uri, b64), options), last)
    return rows.select("token_id", found.alias("f")).select("token_id", "f.route", F.col("f.decoded").alias("value"))


def encoded(plain: DataFrame) -> DataFrame:
    """Every encoding of texts (id, text) as (id, variant, value)."""
    data, text = F.col("text").cast("binary"), F.col("text")
    b64 = F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))
    made = {
        "Base64": b64,
        "Base64URL": F.replace(F.replace(F.rtrim(b64, F.lit("=")), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")),
        "HEX": F.hex(data),
        "Base32": codecs.encode_udf("base32")(text),
        "Quoted-Printable": codecs.encode_udf("quoted-printable")(text),
        **{f"{c}+Base64": codecs.encode_udf(c)(text) for c in codecs.CODECS},
        "LZ-Base64": F.col("_lz"),
        "LZ-URI": F.replace(F.rtrim(F.col("_lz"), F.lit("=")), F.lit("/"), F.lit("-")),  # the same bits in the other alphabet
    }
    rows = plain.where(text.isNotNull()).withColumn("_lz", codecs.encode_udf("lz-base64")(text))
    rows = rows.withColumns({f"_v{i}": v for i, v in enumerate(made.values())})
    tries = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_v{i}").alias("value")) for i, n in enumerate(made)])
    return rows.select("id", F.explode(tries).alias("a")).select("id", "a.*")
