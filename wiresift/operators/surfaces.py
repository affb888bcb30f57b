"""Breaking exchanges into text surfaces, one row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, gates, http
from ..options import DecodeOptions, DetectOptions


def utf8(body: Column) -> Column:
    """Bytes as UTF-8; malformed bytes become replacement characters."""
    return F.make_valid_utf8(body.cast("string"))


def latin1(body: Column) -> Column:
    return F.decode(body, "ISO-8859-1")


def surface(location: Column | str, text: Column) -> Column:
    place = F.lit(location) if isinstance(location, str) else location
    return F.struct(place.alias("location"), text.alias("text"))


def one(location: Column | str, text: Column, when: Column | None = None) -> Column:
    """A list of one surface, or of none where `when` is false or the text is null or empty."""
    some = text.isNotNull() & (text != "")
    if when is not None:
        some = some & F.coalesce(when, F.lit(False))
    return F.filter(F.array(surface(location, text)), lambda _: F.coalesce(some, F.lit(False)))


def decoded_once(location: str, text: Column) -> Column:
    """The form-decoded text, where decoding changes it."""
    out = F.try_url_decode(text)
    return one(location, out, out != text)


def named(prefix: str, pairs: Column, decode: bool = True) -> Column:
    """A surface for each pair with a value, named after it."""

    def each(p: Column) -> Column:
        name, value = p["name"], p["value"]
        if decode:
            name, value = http.form_decoded(name), http.form_decoded(value)
        return surface(F.concat(F.lit(prefix), name), value)

    return F.transform(F.filter(pairs, lambda p: p["value"].isNotNull()), each)


def cookies(headers: Column) -> Column:
    text = F.regexp_replace(F.coalesce(http.header_value(headers, "Cookie"), F.lit("")), r";\s+", ";")
    return http.pairs(text, ";")


def is_form(headers: Column) -> Column:
    return F.coalesce(http.content_type(headers) == "application/x-www-form-urlencoded", F.lit(False))


def multipart_fields(body: Column, headers: Column) -> Column:
    """[(name, value)] of a multipart form's fields that are not files; empty values are left out."""
    kind = http.header_value(headers, "Content-Type")
    boundary = F.regexp_extract(kind, r'(?i)boundary="?([^";]+)"?', 1)
    parts = F.split(body, F.concat(F.lit("\\Q--"), boundary, F.lit("\\E")))
    fields = F.filter(parts, lambda p: p.rlike(r"\r?\n\r?\n") & ~p.rlike(r'(?i)filename\s*='))

    def field(p: Column) -> Column:
        cut = F.split(p, r"\r?\n\r?\n", 2)
        value = F.regexp_replace(F.get(cut, F.lit(1)), r"^\s+|\s+$", "")
        return F.struct(F.regexp_extract(F.get(cut, F.lit(0)), r'name="([^"]*)"', 1).alias("name"), value.alias("value"))

    found = F.filter(F.transform(fields, field), lambda f: f["value"] != "")
    usable = F.coalesce(F.lower(kind).startswith("multipart/") & (boundary != ""), F.lit(False))
    return F.filter(found, lambda _: usable)


def looks_json(body: Column) -> Column:
    """Bytes that begin like a JSON object or list; the parser tells whether they are one."""
    return F.coalesce(latin1(F.substring(body, 1, 64)).rlike(r"^[ \t\n\r]*(?:[\{\[]|$)"), F.lit(False)) & (F.octet_length(body) > 1)


def json_and_xml(headers: Column, body: Column) -> tuple[Column, Column]:
    """A body's text where it begins like JSON, and where its type is XML; else null."""
    text = utf8(body)
    xml = F.coalesce(http.content_type(headers).contains("xml"), F.lit(False))
    return F.when(looks_json(body), text), F.when(xml, text)


def body_parameters(headers: Column, body: Column, params: Column) -> Column:
    """[(ptype, name, value)] of a request body: form fields, multipart fields that are no files, and `params`, those of JSON and XML."""
    text = utf8(body)

    def typed(kind: str, pairs: Column, decode: bool) -> Column:
        def each(p: Column) -> Column:
            name, value = p["name"], p["value"]
            if decode:
                name, value = http.form_decoded(name), http.form_decoded(value)
            return F.struct(F.lit(kind).alias("ptype"), name.alias("name"), value.alias("value"))

        return F.transform(pairs, each)

    none = F.array().cast(codecs.PARAMETERS)
    form = typed("body", http.pairs(F.coalesce(F.when(is_form(headers), text), F.lit("")), "&"), True)
    fields = typed("multipart", multipart_fields(F.coalesce(text, F.lit("")), headers), False)
    return F.concat(form, F.coalesce(fields, none), F.coalesce(params, none))


def exploded(df: DataFrame, surfaces: list[Column], *keep: str) -> DataFrame:
    """One row for each surface with text: `keep`, ordinal, location, text.  The source is read once."""
    rows = df.select(*keep, F.posexplode(F.concat(*surfaces)).alias("ordinal", "s"))
    rows = rows.select(*keep, "ordinal", "s.location", "s.text")
    return rows.where(F.coalesce(F.length("text") > 0, F.lit(False)))


def detection(exchanges: DataFrame, options: DetectOptions = DetectOptions()) -> DataFrame:
    """Surfaces of the detection job: exchange_id, ts, url, ordinal, direction, location, text."""
    rows, out = detection_parts(exchanges, options)
    found = exploded(rows, out, "exchange_id", "ts", "url")
    direction = F.when(F.col("location").startswith("response-"), "response").otherwise("request")
    return found.withColumn("direction", direction)


def detection_parts(exchanges: DataFrame, options: DetectOptions) -> tuple[DataFrame, list[Column]]:
    """Exchanges that the detection job looks at, with their parts as columns, and the surfaces as lists made of those."""
    o = options
    gate = ~gates.is_asset(F.col("url")) if o.skip_assets else F.lit(True)
    rows = exchanges.where(gate).withColumns(
        {
            "path": http.path(F.col("url")),
            "query": http.query(F.col("url")),
            "req_type": http.content_type(F.col("req_headers")),
            "resp_type": http.content_type(F.col("resp_headers")),
        }
    )
    typed = ~gates.is_blocked_type(F.col("resp_type")) if o.skip_blocked_types else F.lit(True)
    sends = gates.has_body_method(F.col("method")) & gates.body_fits(F.col("req_body"), o.max_scan)
    if o.skip_blocked_types:
        sends = sends & ~gates.is_blocked_type(F.col("req_type"))
    answers = typed & gates.body_fits(F.col("resp_body"), o.max_scan)
    rows = rows.withColumn("req_text", F.when(sends, latin1(F.col("req_body"))))
    packed = http.header_value(F.col("resp_headers"), "Content-Encoding")
    plain = ~F.coalesce(F.lower(packed).isin("gzip", "x-gzip", "deflate", "br"), F.lit(False))
    # Only encoded bodies and JSON visit Python, all at once.
    json_back = F.lit(o.scan_json and o.scan_response_body) & answers
    json, xml = json_and_xml(F.col("req_headers"), F.col("req_body"))
    made = codecs.parts_udf(o.inflate_cap, o.min_hex_len)(
        F.when(answers & ~plain, F.col("resp_body")), packed, json_back,
        F.when(json_back & plain & looks_json(F.col("resp_body")), utf8(F.col("resp_body"))), json, xml,
    )
    rows = rows.withColumn("made", made)
    rows = rows.withColumn("bodies", F.when(answers, F.when(plain, F.array("resp_body")).otherwise(F.col("made.bodies"))))

    path, query = F.col("path"), F.col("query")
    out = []
    if o.scan_headers:
        out.append(one("request-headers", F.concat_ws("\n", "req_headers")))
    if o.scan_path:
        out += [one("request-path", path), decoded_once("request-path-decoded", path)]
    if o.scan_query:
        out += [one("request-query", query), decoded_once("request-query-decoded", query)]
    if o.scan_params:
        out.append(named("query-param:", http.pairs(F.coalesce(query, F.lit("")), "&")))
        params = body_parameters(F.col("req_headers"), F.col("req_body"), F.col("made.params"))
        out.append(named("body-param:", params, decode=False))
    if o.scan_cookies or o.scan_headers:
        out.append(named("cookie:", cookies(F.col("req_headers")), decode=False))
    if o.scan_request_body:
        out.append(one("request-body", F.col("req_text")))
    if o.scan_request_body and o.scan_json:
        out.append(F.coalesce(F.when(sends, F.col("made.request")), F.array().cast(surfaces_type())))
    if o.scan_headers:
        out.append(one("response-headers", F.concat_ws("\n", "resp_headers"), typed))
    if o.scan_response_body:
        texts = F.transform("bodies", lambda b: surface("response-body", latin1(b)))
        out.append(F.coalesce(F.filter(texts, lambda s: s["text"] != ""), F.array().cast(surfaces_type())))
        if o.scan_json:
            out.append(F.coalesce("made.response", F.array().cast(surfaces_type())))
    return rows, out


def surfaces_type() -> str:
    return "array<struct<location:string,text:string>>"


# Numbers of the parameter types other than url and form body, in the decode job's labels.
PARAMETER_NUMBERS = {"cookie": 2, "xml": 3, "xml-attr": 4, "multipart": 5, "json": 6}


def decoding(exchanges: DataFrame, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """Surfaces of the decode job: exchange_id, ts, url, tool, ordinal, direction, location, text."""
    path, query = http.path(F.col("url")), F.coalesce(http.query(F.col("url")), F.lit(""))
    json_and_xml_params = codecs.parameters_udf()(*json_and_xml(F.col("req_headers"), F.col("req_body")))
    rows = exchanges.withColumns({"path": path, "query": query, "params": json_and_xml_params})
    layers = http.decode_chain(F.coalesce("path", F.lit("")), 2)

    def segments(layer: Column) -> Column:
        inner = F.regexp_replace(layer, "^/|/$", "")
        parts = F.transform(F.split(inner, "/"), lambda p, i: surface(F.concat(F.lit("path-seg["), i.cast("string"), F.lit("]")), p))
        return F.filter(parts, lambda s: s["text"] != "")

    out = [F.array_distinct(F.flatten(F.transform(layers, segments)))]
    if options.split_semicolons:
        out.append(F.array_distinct(F.flatten(F.transform(layers, semicolon_parts))))
    out.append(named("param-url:", http.pairs(F.col("query"), "&")))
    label = F.create_map(*[F.lit(x) for kind, n in PARAMETER_NUMBERS.items() for x in (kind, f"param-{n}:")], F.lit("body"), F.lit("param-body:"))
    given = F.filter(body_parameters(F.col("req_headers"), F.col("req_body"), F.col("params")), lambda p: p["value"].isNotNull())
    out.append(F.transform(given, lambda p: surface(F.concat(F.try_element_at(label, p["ptype"]), p["name"]), p["value"])))
    out.append(named(f"param-{PARAMETER_NUMBERS['cookie']}:", cookies(F.col("req_headers")), decode=False))
    raw = F.filter(F.split("query", "&"), lambda p: F.instr(p, "=") > 0)
    out.append(F.transform(raw, lambda p: surface(F.concat(F.lit("raw-query:"), F.left(p, F.lit(20))), F.substring(p, F.instr(p, "=") + 1, F.length(p)))))
    out.append(one("query", F.col("query")))
    out.append(kept_headers(F.col("req_headers")))
    typed = gates.is_allowed_type(http.content_type(F.col("req_headers"))) | is_form(F.col("req_headers"))
    out.append(one("body", utf8(F.col("req_body")), typed if options.typed_bodies else None))
    if options.scan_responses:
        out.append(one("resp-body", utf8(F.col("resp_body")), gates.is_allowed_type(http.content_type(F.col("resp_headers")))))
    found = exploded(rows, out, "exchange_id", "ts", "url", "tool")
    direction = F.when(F.col("location") == "resp-body", "response").otherwise("request")
    return found.withColumn("direction", direction)


def semicolon_parts(layer: Column) -> Column:
    """Main part and parameters of path segments with a `;`."""
    inner = F.filter(F.split(F.regexp_replace(layer, "^/|/$", ""), "/"), lambda p: F.instr(p, ";") > 0)
    return F.flatten(
        F.transform(
            inner,
            lambda p: F.array(
                surface("path-seg-main", F.substring_index(p, ";", 1)),
                surface("path-seg-semi", F.substring(p, F.instr(p, ";") + 1, F.length(p))),
            ),
        )
    )


def kept_headers(headers: Column) -> Column:
    """A surface for each header that is not noisy."""
    kept = F.filter(headers, lambda h: ~gates.is_noisy_header(h))
    return F.transform(
        kept,
        lambda h: surface(
            F.concat(F.lit("header:"), F.trim(F.substring_index(h, ":", 1))), F.trim(F.substring(h, F.instr(h, ":") + 1, F.length(h)))
        ),
    )
