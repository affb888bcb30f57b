"""One query for each operator, over the test tables, with the equal SQL where there is one.

Exchanges are the planted ones of sources.exchanges, one for each page.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, digests, gates, http, quality
from .jobs import audit
from .operators import capture, decode, detect, surfaces
from .options import OLDER_DECODE, CaptureOptions, DecodeOptions, DetectOptions
from .sources import exchanges as source
from .sources import sinks, tables
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DETECT, DECODE = DetectOptions(), DecodeOptions()
STRICT = DetectOptions(strict=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.planted(spark, sf_dir)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents and pages as surfaces."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("location"), F.col("doc_id").alias("exchange_id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("location"), F.col("page_id").alias("exchange_id"), F.col("html").alias("text"))
    return docs.unionByName(pages).withColumn("url", F.lit(""))


# SQL that several queries begin with.
EX = f"WITH ex AS ({source.planted_sql(source.DUCK)})"
TEXTS = """WITH texts AS (SELECT 'documents' AS location, doc_id AS exchange_id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages),
runs AS (SELECT location, exchange_id, unnest(regexp_extract_all(text, '[0-9A-Fa-f]+')) AS value FROM texts),
sized AS (SELECT *, length(value) AS hex_len, lower(value) AS low FROM runs WHERE length(value) BETWEEN 8 AND 256),
pairs AS (SELECT *, CASE WHEN hex_len % 2 = 0 THEN list_transform(range(1, hex_len, 2), lambda i: substr(low, i, 2)) END AS p FROM sized),
shares AS (SELECT *, round(list_aggregate(p, 'entropy'), 9) AS entropy,
  round(len(list_filter(p, lambda x: (x BETWEEN '20' AND '7e') OR x IN ('09', '0a', '0d'))) / len(p), 9) AS printable,
  round(len(list_filter(p, lambda x: (x BETWEEN '41' AND '5a') OR (x BETWEEN '61' AND '7a'))) / len(p), 9) AS letters,
  round(len(list_filter(p, lambda x: x = '20')) / len(p), 9) AS spaces,
  len(list_filter(p, lambda x: x IN ('20', '0a', '09'))) > 0 AS spaced FROM pairs)"""
MEMES = ", ".join(f"'{m}'" for m in digests.MEMES)
SKIP = f"(hex_len < 8 OR length(replace(low, left(low, 1), '')) = 0 OR low IN ({MEMES}))"
LIKELY = "(p IS NOT NULL AND entropy >= 3.5 AND NOT (printable >= 0.85 AND spaced) AND NOT (printable >= 0.9 AND letters >= 0.6 AND spaces >= 0.02))"
CANDIDATES = "CASE hex_len " + " ".join(f"WHEN {n} THEN '{', '.join(a)}'" for n, a in digests.ALGORITHMS.items())
CANDIDATES += " ELSE concat(hex_len // 2, '-byte digest (unknown)') END"


def sized_runs(spark, sf_dir):
    rows = texts(spark, sf_dir).where(F.col("text").rlike("[0-9A-Fa-f]{8}"))
    rows = rows.select("location", "exchange_id", F.explode(digests.hex_runs(F.col("text"))).alias("value"))
    return rows.where(F.length("value").between(8, 256)).withColumn("hex_len", F.length("value"))


# --- sources and sinks -----------------------------------------------------


READ_SQL = """SELECT '{0}' AS kind, exchange_id, ts, tool, method, url, len(req_headers) AS n_headers, len(resp_headers) AS n_resp_headers, md5(req_body) AS req_body, md5(resp_body) AS resp_body, NULL AS raw FROM ex"""
BROKEN = """concat('{{"exchange_id": ', page_id, ', "url": "cut off')"""


@query(EX + f" {READ_SQL.format('parquet')} UNION ALL {READ_SQL.format('json')} UNION ALL SELECT 'damaged', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {BROKEN.format()} FROM pages")
def s1_read_exchanges(spark, sf_dir):
    """Exchanges written and read as Parquet and as JSON, the latter with a line that breaks off for each page."""
    rows, top = ex(spark, sf_dir), tables.shared_folder(spark, "stored")
    for kind in ("parquet", "json"):
        source.write(rows, f"{top}/{kind}", kind)
    table(spark, sf_dir, "pages").select(F.expr(BROKEN.format())).write.mode("append").text(f"{top}/json")
    parts = [F.md5("req_body").alias("req_body"), F.md5("resp_body").alias("resp_body")]
    sizes = [F.size("req_headers").alias("n_headers"), F.size("resp_headers").alias("n_resp_headers")]
    names = ("exchange_id", "ts", "tool", "method", "url")
    out = [source.read(spark, f"{top}/{k}", k).select(F.lit(k).alias("kind"), *names, *sizes, *parts, F.lit(None).cast("string").alias("raw")) for k in ("parquet", "json")]
    lost = source.damaged(spark, f"{top}/json", "json").select(F.lit("damaged").alias("kind"), "raw")
    return out[0].unionByName(out[1]).unionByName(lost, allowMissingColumns=True)


@query(r"SELECT replace(replace(replace(text, '\', '\\'), chr(13), '\r'), chr(10), '\n') AS value FROM documents WHERE text IS NOT NULL")
def s2_value_lines(spark, sf_dir):
    return sinks.value_lines(table(spark, sf_dir, "documents").select(F.col("text").alias("value")))


@query(EX + " SELECT concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), '000+0000') AS \"timestamp\", url AS value FROM ex")
def s3_stamped_rows(spark, sf_dir):
    return sinks.stamped(ex(spark, sf_dir).withColumn("value", F.col("url")), "value")


@query(TEXTS + f" SELECT 'Information' AS severity, location, value, {CANDIDATES} AS candidates FROM shares WHERE NOT {SKIP} AND {LIKELY}")
def s4_issue_rows(spark, sf_dir):
    found = detect.findings(texts(spark, sf_dir), DETECT).where(F.col("kind") == "hex")
    return found.select(F.lit("Information").alias("severity"), "location", "value", F.concat_ws(", ", "candidates").alias("candidates"))


@query()
def s5_decoded_export(spark, sf_dir):
    return sinks.export(audit.decode_job(ex(spark, sf_dir)))


# --- gates -----------------------------------------------------------------

PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = r"nullif(regexp_extract(url, '\?([^#]*)', 1), '')"


@query(EX + f" SELECT exchange_id, regexp_matches(lower({PATH}), '\\.(js|css|map|woff2?|ttf|otf|eot|svg|ico)$') AS asset FROM ex")
def f1_skip_assets(spark, sf_dir):
    return ex(spark, sf_dir).select("exchange_id", gates.is_asset(F.col("url")).alias("asset"))


TYPE = r"lower(trim(split_part(regexp_extract(resp_headers[1], '^[^:]*:\s*(.*)$', 1), ';', 1)))"


@query(EX + f", typed AS (SELECT exchange_id, {TYPE} AS kind FROM ex) SELECT exchange_id, coalesce(regexp_matches(kind, '{gates.BLOCKED_TYPE}'), false) AS blocked FROM typed")
def f2_blocked_types(spark, sf_dir):
    return ex(spark, sf_dir).select("exchange_id", gates.is_blocked_type(http.content_type(F.col("resp_headers"))).alias("blocked"))


@query(EX + f", typed AS (SELECT exchange_id, {TYPE} AS kind FROM ex) SELECT exchange_id, kind IS NULL OR kind = '' OR " + " OR ".join(f"contains(kind, '{t}')" for t in gates.ALLOWED_TYPES) + " AS allowed FROM typed")
def f3_allowed_types(spark, sf_dir):
    return ex(spark, sf_dir).select("exchange_id", gates.is_allowed_type(http.content_type(F.col("resp_headers"))).alias("allowed"))


@query(EX + " SELECT exchange_id, upper(method) IN ('POST', 'PUT', 'PATCH') AS sends FROM ex")
def f4_body_methods(spark, sf_dir):
    return ex(spark, sf_dir).select("exchange_id", gates.has_body_method(F.col("method")).alias("sends"))


@query(EX + " SELECT exchange_id FROM ex WHERE strlen(resp_body) BETWEEN 1 AND 3000")
def f5_body_sizes(spark, sf_dir):
    return ex(spark, sf_dir).where(gates.body_fits(F.col("resp_body"), 3000)).select("exchange_id")


SCOPE = [("shop.example.com", "/item/"), ("example.org", "/t/"), ("example.net", "/go/")]


@query(EX + f" SELECT exchange_id FROM ex WHERE " + " OR ".join(f"(regexp_extract(url, '://([^/:?#]+)', 1) = '{h}' AND starts_with({PATH}, '{p}'))" for h, p in SCOPE))
def f6_scope(spark, sf_dir):
    scope = spark.createDataFrame(SCOPE, "host string, path_prefix string")
    return decode.in_scope(ex(spark, sf_dir), scope).select("exchange_id")


@query(EX + r""", h AS (SELECT exchange_id, unnest(req_headers) AS header FROM ex), n AS (SELECT *, lower(trim(split_part(header, ':', 1))) AS name FROM h)
SELECT exchange_id, header FROM n WHERE NOT (name IN ('cookie', 'set-cookie', 'authorization', 'user-agent', 'referer', 'cache-control', 'priority')
  OR starts_with(name, 'accept-') OR starts_with(name, 'sec-fetch') OR NOT contains(header, ':'))""")
def f7_noisy_headers(spark, sf_dir):
    rows = ex(spark, sf_dir).select("exchange_id", F.explode("req_headers").alias("header"))
    return rows.where(~gates.is_noisy_header(F.col("header")))


@query(EX + f" SELECT exchange_id, 'request-headers' AS location FROM ex WHERE NOT regexp_matches(lower({PATH}), '\\.(js|css|map|woff2?|ttf|otf|eot|svg|ico)$') "
  f"UNION ALL SELECT exchange_id, unnest(['cookie:sid', 'cookie:theme']) FROM ex WHERE NOT regexp_matches(lower({PATH}), '\\.(js|css|map|woff2?|ttf|otf|eot|svg|ico)$') "
  f"UNION ALL SELECT exchange_id, 'response-headers' FROM ex WHERE resp_headers IS NOT NULL AND NOT regexp_matches(lower({PATH}), '\\.(js|css|map|woff2?|ttf|otf|eot|svg|ico)$') AND NOT regexp_matches({TYPE}, '{gates.BLOCKED_TYPE}')")
def f8_surface_toggles(spark, sf_dir):
    only = dict(scan_path=False, scan_query=False, scan_params=False, scan_request_body=False, scan_response_body=False, scan_json=False)
    rows = surfaces.detection(ex(spark, sf_dir), DetectOptions(scan_headers=True, **only))
    return rows.select("exchange_id", "location")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 1 AND 4096")
def f9_input_bounds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(gates.input_fits(F.col("text"), 1, 4096)).select("doc_id", F.length("text").alias("n"))


# --- surfaces --------------------------------------------------------------


@query(EX + f" SELECT exchange_id, {TYPE} AS kind, regexp_extract(req_headers[5], '^[^:]*:\\s*(.*)$', 1) AS token FROM ex")
def p1_header_values(spark, sf_dir):
    kind, token = http.content_type(F.col("resp_headers")), http.header_value(F.col("req_headers"), "x-TOKEN")
    return ex(spark, sf_dir).select("exchange_id", kind.alias("kind"), token.alias("token"))


@query(EX + f" SELECT exchange_id, {PATH} AS path, {QUERY} AS query, regexp_extract(url, '://([^/:?#]+)', 1) AS host, coalesce(try_cast(regexp_extract(url, '://[^/?#]*:([0-9]+)', 1) AS INT), -1) AS port FROM ex")
def p2_url_parts(spark, sf_dir):
    url = F.col("url")
    return ex(spark, sf_dir).select("exchange_id", http.path(url).alias("path"), http.query(url).alias("query"), http.host(url).alias("host"), http.port(url).alias("port"))


DECODED = "url_decode(replace({0}, '+', ' '))"


@query(EX + f", q AS (SELECT exchange_id, {QUERY} AS query FROM ex) SELECT exchange_id, {DECODED.format('query')} AS text FROM q WHERE {DECODED.format('query')} <> query")
def p3_decoded_once(spark, sf_dir):
    rows = ex(spark, sf_dir).select("exchange_id", F.explode(surfaces.decoded_once("q", http.query(F.col("url")))).alias("s"))
    return rows.select("exchange_id", "s.text")


@query(EX + f", a AS (SELECT exchange_id, {PATH} AS x0 FROM ex), b AS (SELECT *, {DECODED.format('x0')} AS x1 FROM a), c AS (SELECT *, {DECODED.format('x1')} AS x2 FROM b), d AS (SELECT *, {DECODED.format('x2')} AS x3 FROM c) "
  "SELECT exchange_id, x0 AS layer FROM d UNION SELECT exchange_id, x1 FROM d UNION SELECT exchange_id, x2 FROM d UNION SELECT exchange_id, x3 FROM d")
def p4_decode_chain(spark, sf_dir):
    return ex(spark, sf_dir).select("exchange_id", F.explode(http.decode_chain(http.path(F.col("url")), 3)).alias("layer"))


@query(EX + f", a AS (SELECT exchange_id, {PATH} AS x0 FROM ex), b AS (SELECT *, {DECODED.format('x0')} AS x1 FROM a), c AS (SELECT *, {DECODED.format('x1')} AS x2 FROM b), "
  "l AS (SELECT exchange_id, x0 AS layer FROM c UNION SELECT exchange_id, x1 FROM c UNION SELECT exchange_id, x2 FROM c), "
  "s AS (SELECT exchange_id, string_split(regexp_replace(layer, '^/|/$', '', 'g'), '/') AS parts FROM l), i AS (SELECT exchange_id, parts, unnest(range(len(parts))) AS i FROM s) "
  "SELECT DISTINCT exchange_id, concat('path-seg[', i, ']') AS location, parts[i + 1] AS text FROM i WHERE parts[i + 1] <> ''")
def p5_path_segments(spark, sf_dir):
    """Segments of every decode layer of every path, as the decode job sees them."""
    rows = surfaces.decoding(ex(spark, sf_dir))
    return rows.where(F.col("location").startswith("path-seg[")).select("exchange_id", "location", "text")


@query(EX + f", s AS (SELECT exchange_id, unnest(string_split(regexp_replace({PATH}, '^/|/$', '', 'g'), '/')) AS seg FROM ex) SELECT exchange_id, 'path-seg-main' AS location, split_part(seg, ';', 1) AS text FROM s WHERE contains(seg, ';') UNION ALL SELECT exchange_id, 'path-seg-semi', substr(seg, instr(seg, ';') + 1) FROM s WHERE contains(seg, ';')")
def p6_semicolon_parts(spark, sf_dir):
    rows = ex(spark, sf_dir).select("exchange_id", F.explode(surfaces.semicolon_parts(http.path(F.col("url")))).alias("s"))
    return rows.select("exchange_id", "s.location", "s.text")


@query(EX + f", q AS (SELECT exchange_id, unnest(string_split({QUERY}, '&')) AS p FROM ex) SELECT exchange_id, concat('raw-query:', left(p, 20)) AS location, substr(p, instr(p, '=') + 1) AS text FROM q WHERE contains(p, '=') AND substr(p, instr(p, '=') + 1) <> ''")
def p7_raw_query_values(spark, sf_dir):
    rows = surfaces.decoding(ex(spark, sf_dir))
    return rows.where(F.col("location").startswith("raw-query:")).select("exchange_id", "location", "text")


@query(EX + f", q AS (SELECT exchange_id, 'url' AS ptype, unnest(string_split({QUERY}, '&')) AS p FROM ex UNION ALL SELECT exchange_id, 'body', unnest(string_split(req_body, '&')) FROM ex WHERE req_body IS NOT NULL AND contains(req_headers[6], 'form')), "
  f"v AS (SELECT exchange_id, ptype, {DECODED.format('split_part(p, chr(61), 1)')} AS name, {DECODED.format('substr(p, instr(p, chr(61)) + 1)')} AS value FROM q WHERE contains(p, '=')) SELECT * FROM v WHERE value <> '' UNION ALL SELECT exchange_id, 'json', j.key, j.atom ->> '$' FROM ex, json_tree(CASE WHEN exchange_id % 12 = 5 THEN req_body END) AS j WHERE j.type = 'VARCHAR' AND NOT ends_with(j.fullkey, ']')")
def p8_parameters(spark, sf_dir):
    return capture.inputs(ex(spark, sf_dir)).select("exchange_id", "ptype", "name", "value")


@query(EX + f""", q AS (SELECT exchange_id, 'param-url:' AS pre, unnest(string_split({QUERY}, '&')) AS p FROM ex UNION ALL SELECT exchange_id, 'param-body:', unnest(string_split(req_body, '&')) FROM ex WHERE req_body IS NOT NULL AND contains(req_headers[6], 'form')),
c AS (SELECT exchange_id, unnest(string_split(substr(req_headers[2], 9), ';')) AS c FROM ex)
SELECT exchange_id, concat(pre, {DECODED.format('split_part(p, chr(61), 1)')}) AS location, {DECODED.format('substr(p, instr(p, chr(61)) + 1)')} AS text FROM q WHERE contains(p, '=') AND substr(p, instr(p, '=') + 1) <> ''
UNION ALL SELECT exchange_id, concat('param-2:', trim(split_part(c, '=', 1))), substr(c, instr(c, '=') + 1) FROM c
UNION ALL SELECT exchange_id, concat('param-6:', j.key), j.atom ->> '$' FROM ex, json_tree(CASE WHEN exchange_id % 12 = 5 THEN req_body END) AS j WHERE j.type = 'VARCHAR' AND NOT ends_with(j.fullkey, ']')""")
def p8_typed_surfaces(spark, sf_dir):
    """Parameters of all types under the decode job's labels."""
    rows = surfaces.decoding(ex(spark, sf_dir))
    return rows.where(F.col("location").startswith("param-")).select("exchange_id", "location", "text")


@query("""SELECT page_id AS exchange_id, 'xml' AS ptype, 'link' AS name, url AS value FROM pages WHERE trim(url) <> '' UNION ALL SELECT page_id, 'xml-attr', 'id', concat('p', page_id) FROM pages
UNION ALL SELECT page_id, 'xml', 'note', concat('a < b & ', md5(concat('k', page_id))) FROM pages WHERE page_id % 3 > 0""")
def p8_xml_parameters(spark, sf_dir):
    """Requests with XML bodies: elements, attributes, entities and CDATA."""
    url = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    note = F.concat(F.lit("<note>a &lt; b <![CDATA[& "), F.md5(F.concat(F.lit("k"), F.col("page_id").cast("string"))), F.lit("]]></note>"))
    note = F.when(F.col("page_id") % 3 > 0, note).otherwise(F.lit("<note/>"))
    body = F.concat(F.lit("<?xml version='1.0'?><page id='p"), F.col("page_id").cast("string"), F.lit("'>\n<link>"), url, F.lit("</link>"), note, F.lit("</page>"))
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(
        F.col("page_id").alias("exchange_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit("https://a.example/x").alias("url"),
        F.array(F.lit("Content-Type: text/xml; charset=utf-8")).alias("req_headers"), body.cast("binary").alias("req_body"),
    )
    return capture.inputs(rows).select("exchange_id", "ptype", "name", "value")


@query("SELECT doc_id AS exchange_id, 'field' AS name, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS value FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' UNION ALL SELECT doc_id, 'lang', lang FROM documents")
def p9_multipart_fields(spark, sf_dir):
    """Documents as multipart bodies with two fields and a file."""
    field = 'Content-Disposition: form-data; name="{}"{}\r\n\r\n'
    parts = [("field", "", "text"), ("lang", "", "lang"), ("file", '; filename="a.txt"', "source")]
    made = [x for n, f, c in parts for x in (F.lit("--XyZ\r\n" + field.format(n, f)), F.col(c), F.lit("\r\n"))]
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select(F.col("doc_id").alias("exchange_id"), F.concat(*made, F.lit("--XyZ--\r\n")).alias("body"), F.array(F.lit('Content-Type: multipart/form-data; boundary="XyZ"')).alias("h"))
    return rows.select("exchange_id", F.explode(surfaces.multipart_fields(F.col("body"), F.col("h"))).alias("p")).select("exchange_id", "p.name", "p.value")


JSON_SQL = "exchange_id % 12 = 5"


@query(EX + r""" SELECT exchange_id, concat('request-body-json', regexp_replace(replace(substr(j.fullkey, 2), '.', ':key:'), '\[([0-9]+)\]', ':idx:\1', 'g')) AS location, concat(j.key, '=', j.atom ->> '$') AS text
FROM ex, json_tree(CASE WHEN exchange_id % 12 = 5 THEN req_body END) AS j WHERE j.type = 'VARCHAR' AND NOT ends_with(j.fullkey, ']')""")
def p10_json_leaves(spark, sf_dir):
    rows = surfaces.detection(ex(spark, sf_dir))
    return rows.where(F.col("location").startswith("request-body-json:")).select("exchange_id", "location", "text")


@query("SELECT page_id, codec, md5(html) AS digest FROM pages, (VALUES ('gzip'), ('deflate'), ('br'), ('none')) AS c(codec)")
def p11_inflate(spark, sf_dir):
    """Pages packed with every content encoding and unpacked again; `none` are bodies that are not what their encoding says."""

    def run(b):
        htmls = [None if h is None else h.encode() for h in b.column("html").to_pylist()]
        for name, encoding, codec in (("gzip", "gzip", "gzip"), ("deflate", "deflate", "zlib"), ("br", "br", "brotli"), ("none", "gzip", None)):
            packed = [h if h is None or codec is None else codecs.compress(h, codec) for h in htmls]
            bodies = [(codecs.inflate(p, encoding, 5_000_000) or [None])[0] for p in packed]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([name] * len(bodies)), pa.array(bodies, pa.binary())], names=["page_id", "codec", "body"])

    rows = codecs.in_slices(table(spark, sf_dir, "pages").select("page_id", "html"), run, "page_id long, codec string, body binary")
    return rows.select("page_id", "codec", F.md5("body").alias("digest"))


@query("SELECT page_id, length(html) AS n, md5(html) AS digest FROM pages")
def p12_utf8_bodies(spark, sf_dir):
    text = surfaces.utf8(F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n"), F.md5(text).alias("digest"))


NOT_ASSET = f"NOT regexp_matches(lower({PATH}), '\\.(js|css|map|woff2?|ttf|otf|eot|svg|ico)$')"
SURFACES_SQL = (
    EX + f""", u AS (SELECT *, {PATH} AS path, {QUERY} AS query, {TYPE} AS kind, contains(req_headers[6], 'form') AS form FROM ex WHERE {NOT_ASSET}),
pairs AS (SELECT exchange_id, ts, url, 'query-param:' AS pre, unnest(string_split(query, '&')) AS p FROM u UNION ALL
  SELECT exchange_id, ts, url, 'body-param:', unnest(string_split(req_body, '&')) FROM u WHERE form AND method = 'POST' AND req_body IS NOT NULL),
s AS (SELECT exchange_id, ts, url, 'request-path' AS location, path AS text FROM u
  UNION ALL SELECT exchange_id, ts, url, 'request-path-decoded', {DECODED.format('path')} FROM u WHERE {DECODED.format('path')} <> path
  UNION ALL SELECT exchange_id, ts, url, 'request-query', query FROM u
  UNION ALL SELECT exchange_id, ts, url, 'request-query-decoded', {DECODED.format('query')} FROM u WHERE {DECODED.format('query')} <> query
  UNION ALL SELECT exchange_id, ts, url, concat(pre, {DECODED.format('split_part(p, chr(61), 1)')}), {DECODED.format('substr(p, instr(p, chr(61)) + 1)')} FROM pairs WHERE contains(p, '=')
  UNION ALL SELECT exchange_id, ts, url, 'request-body', req_body FROM u WHERE method = 'POST'
  UNION ALL SELECT exchange_id, ts, url, 'request-body-json:key:md5', concat('md5=', md5(concat('k', exchange_id))) FROM u WHERE {JSON_SQL}
  UNION ALL SELECT exchange_id, ts, url, 'request-body-json:key:list:idx:1:key:sha1', concat('sha1=', sha1(concat('k', exchange_id))) FROM u WHERE {JSON_SQL}
  UNION ALL SELECT exchange_id, ts, url, 'body-param:md5', md5(concat('k', exchange_id)) FROM u WHERE {JSON_SQL}
  UNION ALL SELECT exchange_id, ts, url, 'body-param:sha1', sha1(concat('k', exchange_id)) FROM u WHERE {JSON_SQL}
  UNION ALL SELECT exchange_id, ts, url, 'response-body', resp_body FROM u WHERE NOT coalesce(regexp_matches(kind, '{gates.BLOCKED_TYPE}'), false)),
surf AS (SELECT * FROM s WHERE text <> '')"""
)


@query(SURFACES_SQL + " SELECT exchange_id, location, CASE WHEN location IN ('request-body', 'response-body') THEN strlen(text) ELSE length(text) END AS n FROM surf")
def p13_surface_union(spark, sf_dir):
    """Every surface with its length; bodies are read byte by byte."""
    return surfaces.detection(ex(spark, sf_dir)).select("exchange_id", "location", F.length("text").cast("long").alias("n"))


ALLOWED = "(kind IS NULL OR kind = '' OR " + " OR ".join(f"contains(kind, '{t}')" for t in gates.ALLOWED_TYPES) + ")"


@query(EX + r""", h AS (SELECT exchange_id, unnest(req_headers) AS header FROM ex), n AS (SELECT *, lower(split_part(header, ':', 1)) AS name FROM h)
SELECT exchange_id, concat('header:', split_part(header, ':', 1)) AS location, trim(substr(header, instr(header, ':') + 1)) AS text FROM n WHERE name NOT IN ('cookie', 'user-agent', 'accept-language')
UNION ALL """ + f"SELECT exchange_id, 'query', {QUERY} FROM ex WHERE {QUERY} IS NOT NULL UNION ALL SELECT exchange_id, 'body', req_body FROM ex WHERE req_body <> '' "
  f"UNION ALL SELECT exchange_id, 'resp-body', resp_body FROM (SELECT *, {TYPE} AS kind FROM ex) WHERE resp_body <> '' AND {ALLOWED}")
def p14_whole_texts(spark, sf_dir):
    rows = surfaces.decoding(ex(spark, sf_dir))
    whole = F.col("location").startswith("header:") | F.col("location").isin("query", "body", "resp-body")
    return rows.where(whole).select("exchange_id", "location", "text")


# --- detection -------------------------------------------------------------

MCF_SQL = r"unnest(regexp_extract_all(text, '\$(?:1|2a|2b|2y|5|6)\$\S{1,100}|\$apr1\$\S{1,100}|\$pbkdf2-sha(?:1|256)\$\S{1,200}|\$argon2(?:id|i|d)\$\S{1,300}'))"


@query(SURFACES_SQL + f" SELECT exchange_id, location, {MCF_SQL} AS value FROM surf")
def d1_mcf(spark, sf_dir):
    rows = surfaces.detection(ex(spark, sf_dir))
    return rows.select("exchange_id", "location", F.explode(digests.mcf_strings(F.col("text"))).alias("value"))


LABEL_RE = rf"(?i)\b(?:{'|'.join(digests.LABELS)})\b\s*[:=]\s*[0-9A-Fa-f]{{8,256}}"
LABEL_SQL = SURFACES_SQL + f""", lab AS (SELECT *, unnest(regexp_extract_all(text, '{LABEL_RE}')) AS m FROM surf),
labelled AS (SELECT exchange_id, ts, url, location, lower(regexp_extract(m, '^[A-Za-z0-9-]+')) AS label, regexp_extract(m, '([0-9A-Fa-f]+)$') AS value FROM lab)"""


@query(LABEL_SQL + " SELECT exchange_id, location, label, value FROM labelled")
def d2_labelled(spark, sf_dir):
    rows = surfaces.detection(ex(spark, sf_dir))
    return rows.select("exchange_id", "location", F.explode(digests.labelled(F.col("text"))).alias("p")).select("exchange_id", "location", "p.label", "p.value")


@query(TEXTS + " SELECT location, exchange_id, value, hex_len FROM sized")
def d3_hex_runs(spark, sf_dir):
    return sized_runs(spark, sf_dir)


@query(TEXTS + f" SELECT location, exchange_id, value FROM sized WHERE NOT {SKIP}")
def d4_skip_rules(spark, sf_dir):
    return sized_runs(spark, sf_dir).where(~digests.is_skipped(F.col("value"), 8)).select("location", "exchange_id", "value")


@query(TEXTS + " SELECT location, exchange_id, value, entropy, entropy >= 3.5 AS passes FROM shares WHERE p IS NOT NULL")
def d5_entropy(spark, sf_dir):
    rows = sized_runs(spark, sf_dir).withColumn("p", digests.byte_pairs(F.col("value"))).where("p IS NOT NULL")
    bits = digests.entropy(F.col("p"))
    return rows.select("location", "exchange_id", "value", bits.alias("entropy"), (bits >= 3.5).alias("passes"))


@query(TEXTS + " SELECT location, exchange_id, value, printable, printable >= 0.85 AND spaced AS is_text FROM shares WHERE p IS NOT NULL")
def d6_printable(spark, sf_dir):
    rows = sized_runs(spark, sf_dir).withColumn("p", digests.byte_pairs(F.col("value"))).where("p IS NOT NULL")
    share = F.round(digests.printable_share(F.col("p")), 9)
    return rows.select("location", "exchange_id", "value", share.alias("printable"), digests.looks_like_text(F.col("p"), 0.85).alias("is_text"))


def whole_english(docs: DataFrame, vowel_check: bool = False) -> DataFrame:
    """Every row's verdict over all bytes of its text; an empty or null text is not English."""
    return docs.select("doc_id", F.coalesce(digests.text_looks_english(F.col("text"), vowel_check), F.lit(False)).alias("english"))


@query("""WITH q AS (SELECT doc_id, regexp_extract_all(lower(hex(encode(text))), '..') AS p FROM documents)
SELECT doc_id, coalesce(len(list_filter(p, lambda x: (x BETWEEN '20' AND '7e') OR x IN ('09', '0a', '0d'))) / len(p) >= 0.9
 AND len(list_filter(p, lambda x: (x BETWEEN '41' AND '5a') OR (x BETWEEN '61' AND '7a'))) / len(p) >= 0.6 AND len(list_filter(p, lambda x: x = '20')) / len(p) >= 0.02, false) AS english FROM q""")
def d7_english(spark, sf_dir):
    return whole_english(table(spark, sf_dir, "documents"))


@query("""WITH q AS (SELECT doc_id, regexp_extract_all(lower(hex(encode(text))), '..') AS p FROM documents),
n AS (SELECT doc_id, len(p) AS n, len(list_filter(p, lambda x: (x BETWEEN '20' AND '7e') OR x IN ('09', '0a', '0d'))) AS printable, len(list_filter(p, lambda x: (x BETWEEN '41' AND '5a') OR (x BETWEEN '61' AND '7a'))) AS letters,
  len(list_filter(p, lambda x: x = '20')) AS blanks, len(list_filter(p, lambda x: x IN ('41', '45', '49', '4f', '55', '61', '65', '69', '6f', '75'))) AS vowels FROM q)
SELECT doc_id, coalesce(printable / n >= 0.9 AND letters / n >= 0.6 AND blanks / n >= 0.02 AND vowels / letters BETWEEN 0.25 AND 0.5, false) AS english FROM n""")
def d7_vowel_check(spark, sf_dir):
    """The older test, which also weighs vowels against letters."""
    return whole_english(table(spark, sf_dir, "documents"), vowel_check=True)


@query(TEXTS + " SELECT location, exchange_id, value FROM sized WHERE hex_len IN (32, 40, 56, 64, 96, 128)")
def d8_exact_lengths(spark, sf_dir):
    return sized_runs(spark, sf_dir).where(digests.is_exact_length(F.col("value"))).select("location", "exchange_id", "value")


@query(TEXTS + " SELECT location, exchange_id, value, round(length(regexp_replace(value, '[^0-9]', '', 'g')) / hex_len, 9) AS digits FROM sized")
def d9_digit_share(spark, sf_dir):
    return sized_runs(spark, sf_dir).select("location", "exchange_id", "value", F.round(digests.digit_share(F.col("value")), 9).alias("digits"))


KEYWORDS = "|".join(digests.LOCAL_KEYWORDS)


#: hex runs with their place: what stands before a run, runs and gaps, is as long as its start
PLACED = f""", parts AS (SELECT exchange_id, ts, url, location, text, regexp_extract_all(text, '[0-9A-Fa-f]+') AS runs, regexp_split_to_array(text, '[0-9A-Fa-f]+') AS gaps FROM surf),
numbered AS (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM parts),
placed AS (SELECT exchange_id, ts, url, location, text, runs[i] AS value, length(list_aggregate(gaps[:i], 'string_agg', '')) + coalesce(length(list_aggregate(runs[:i - 1], 'string_agg', '')), 0) AS start FROM numbered WHERE length(runs[i]) >= {DETECT.min_hex_len}),
near AS (SELECT exchange_id, ts, url, location, value, regexp_matches(lower(substr(text, greatest(0, start - 50) + 1, start + length(value) + 50 - greatest(0, start - 50))), '{KEYWORDS}') AS near FROM placed)"""


@query(SURFACES_SQL + PLACED + " SELECT exchange_id, location, value, near FROM near")
def d10_local_context(spark, sf_dir):
    """Every surface and every run that the detect job looks at."""
    rows = surfaces.detection(ex(spark, sf_dir), DETECT)
    rows = rows.select("exchange_id", "location", F.explode(digests.runs_with_context(F.col("text"), DETECT.min_hex_len)).alias("r"))
    return rows.select("exchange_id", "location", "r.value", F.col("r.around").rlike(KEYWORDS).alias("near"))


@query(SURFACES_SQL + f" SELECT exchange_id, location, CASE WHEN regexp_matches(lower(text), '{'|'.join(digests.CONTEXT_KEYWORDS)}') THEN 'Firm' ELSE 'Tentative' END AS confidence FROM surf")
def d11_confidence(spark, sf_dir):
    sure = F.when(digests.has_keyword(F.col("text")), "Firm").otherwise("Tentative")
    return surfaces.detection(ex(spark, sf_dir)).select("exchange_id", "location", sure.alias("confidence"))


@query(TEXTS.replace("SELECT location, exchange_id, unnest", "SELECT location, exchange_id, text, unnest") + f""" SELECT location, exchange_id, value,
  CASE WHEN regexp_matches(lower(text), '{'|'.join(digests.CONTEXT_KEYWORDS)}') THEN 'Firm' ELSE 'Tentative' END AS confidence FROM shares WHERE NOT {SKIP} AND {LIKELY}""")
def d11_require_context(spark, sf_dir):
    """Findings in all texts, relabelled by their surface's words."""
    found = detect.findings(texts(spark, sf_dir), DetectOptions(require_context=True)).where("kind = 'hex'")
    return found.select("location", "exchange_id", "value", "confidence")


@query(TEXTS + f" SELECT location, exchange_id, value, {CANDIDATES} AS candidates FROM sized")
def d12_candidates(spark, sf_dir):
    names = F.concat_ws(", ", digests.candidates(F.col("value")))
    return sized_runs(spark, sf_dir).select("location", "exchange_id", "value", names.alias("candidates"))


def find_sql(hexes: str, strict: str = "") -> str:
    """Findings from the CTE of hex runs (exchange_id, ts, url, location, value, near) and `surf`."""
    return LABEL_SQL + hexes + f""", matches AS (SELECT exchange_id, ts, url, location, NULL AS label, value, 'hex' AS kind, near FROM hexes
  UNION ALL SELECT exchange_id, ts, url, location, label, value, 'label', true FROM labelled),
g1 AS (SELECT *, length(value) AS hex_len, lower(value) AS low FROM matches WHERE length(value) BETWEEN 8 AND 256),
g2 AS (SELECT *, CASE WHEN hex_len % 2 = 0 THEN list_transform(range(1, hex_len, 2), lambda i: substr(low, i, 2)) END AS p FROM g1),
g3 AS (SELECT *, round(list_aggregate(p, 'entropy'), 9) AS entropy,
  round(len(list_filter(p, lambda x: (x BETWEEN '20' AND '7e') OR x IN ('09', '0a', '0d'))) / len(p), 9) AS printable,
  round(len(list_filter(p, lambda x: (x BETWEEN '41' AND '5a') OR (x BETWEEN '61' AND '7a'))) / len(p), 9) AS letters,
  round(len(list_filter(p, lambda x: x = '20')) / len(p), 9) AS spaces, len(list_filter(p, lambda x: x IN ('20', '0a', '09'))) > 0 AS spaced FROM g2),
kept AS (SELECT * FROM g3 WHERE NOT {SKIP} AND {LIKELY}{strict}),
mcf AS (SELECT exchange_id, ts, url, location, {MCF_SQL} AS value FROM surf),
found AS (SELECT exchange_id, ts, url, kind, value, CASE kind WHEN 'hex' THEN 'Hash/token (hex)' ELSE concat('Hash/token (label:', label, ')') END AS title,
  concat('Location: ', location, '<br>Value: <b>', value, '</b><br>', CASE kind WHEN 'hex' THEN concat('Len: ', hex_len, '<br>Candidates: ', {CANDIDATES}) ELSE concat('Label: ', label) END) AS detail FROM kept
  UNION ALL SELECT exchange_id, ts, url, 'mcf', value, 'Hash/token (MCF)', concat('Location: ', location, '<br>Value: <b>', value, '</b><br>Type: MCF') FROM mcf)"""


FIND_SQL = find_sql(", hexes AS (SELECT exchange_id, ts, url, location, unnest(regexp_extract_all(text, '[0-9A-Fa-f]+')) AS value, true AS near FROM surf)")
EXEMPT = " OR ".join(f"starts_with(location, '{x}')" for x in digests.EXEMPT_LOCATIONS)
STRICT_SQL = find_sql(
    PLACED + ", hexes AS (SELECT * FROM near)",
    f""" AND (kind = 'label' OR (length(regexp_replace(value, '[^0-9]', '', 'g')) / hex_len >= 0.10
  AND (hex_len IN ({', '.join(map(str, digests.EXACT_LENGTHS))}) OR near OR {EXEMPT})))""",
)


@query(FIND_SQL + " SELECT exchange_id, kind, title, value, detail FROM found")
def d13_findings(spark, sf_dir):
    found = detect.findings(surfaces.detection(ex(spark, sf_dir), DETECT), DETECT)
    return found.select("exchange_id", "kind", "title", "value", "detail")


@query(FIND_SQL + " SELECT DISTINCT url, title, detail FROM found")
def d14_distinct_findings(spark, sf_dir):
    return audit.detect_job(ex(spark, sf_dir)).select("url", "title", "detail")


@query(STRICT_SQL + " SELECT exchange_id, kind, title, value, detail FROM found")
def d15_strict_findings(spark, sf_dir):
    found = detect.findings(surfaces.detection(ex(spark, sf_dir), STRICT), STRICT)
    return found.select("exchange_id", "kind", "title", "value", "detail")


# --- capture ---------------------------------------------------------------


@query(FIND_SQL + " SELECT value, min(ts) AS ts FROM found GROUP BY value")
def j1_distinct_hashes(spark, sf_dir):
    return capture.distinct_hashes(detect.findings(surfaces.detection(ex(spark, sf_dir))))


INPUTS_SQL = f""", ip AS (SELECT exchange_id, ts, unnest(string_split({QUERY}, '&')) AS p FROM ex UNION ALL SELECT exchange_id, ts, unnest(string_split(req_body, '&')) FROM ex WHERE req_body IS NOT NULL AND contains(req_headers[6], 'form')),
inputs AS (SELECT exchange_id, ts, {DECODED.format('split_part(p, chr(61), 1)')} AS name, {DECODED.format('substr(p, instr(p, chr(61)) + 1)')} AS value FROM ip WHERE contains(p, '=') AND substr(p, instr(p, '=') + 1) <> ''
  UNION ALL SELECT exchange_id, ts, 'md5', md5(concat('k', exchange_id)) FROM ex WHERE {JSON_SQL} UNION ALL SELECT exchange_id, ts, 'sha1', sha1(concat('k', exchange_id)) FROM ex WHERE {JSON_SQL})"""


@query(EX + INPUTS_SQL + " SELECT name AS param_name, value, min(ts) AS ts FROM inputs GROUP BY 1, 2")
def j2_distinct_inputs(spark, sf_dir):
    return capture.distinct_inputs(capture.inputs(ex(spark, sf_dir)))


@query(FIND_SQL + INPUTS_SQL + " SELECT exchange_id, name, value FROM inputs WHERE exchange_id IN (SELECT exchange_id FROM found) AND length(value) BETWEEN 1 AND 4096")
def j3_inputs_of_findings(spark, sf_dir):
    rows = ex(spark, sf_dir)
    found = detect.findings(surfaces.detection(rows))
    return capture.inputs_of_findings(capture.inputs(rows), found).select("exchange_id", "name", "value")


@query(FIND_SQL + INPUTS_SQL + """, h AS (SELECT DISTINCT value AS hash FROM found), v AS (SELECT DISTINCT value AS plain FROM inputs),
d AS (SELECT plain, 'md5' AS algorithm, md5(plain) AS digest FROM v UNION ALL SELECT plain, 'sha1', sha1(plain) FROM v UNION ALL SELECT plain, 'sha256', sha256(plain) FROM v)
SELECT hash, algorithm, plain FROM h JOIN d ON lower(hash) = digest""")
def j4_match_hashes(spark, sf_dir):
    """All captured hashes against all captured inputs, by all six digests; three of them are planted."""
    rows = ex(spark, sf_dir)
    hashes = capture.distinct_hashes(detect.findings(surfaces.detection(rows, DETECT), DETECT))
    return capture.matched(hashes, capture.distinct_inputs(capture.inputs(rows)))


def planted_tokens(spark, sf_dir):
    """Every encoding of a short text for each page, as (token_id, token)."""
    pages = table(spark, sf_dir, "pages")
    plain = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("user="), F.col("page_id").cast("string"), F.lit("&note=hello world")).alias("text"))
    made = decode.encoded(plain)
    return made.select(F.concat(F.col("id").cast("string"), F.lit("/"), F.col("variant")).alias("token_id"), F.col("value").alias("token"))


PLAIN = "WITH pl AS (SELECT page_id, concat('user=', page_id, '&note=hello world') AS x FROM pages)"


def varied(spark, sf_dir):
    """A text of its own for each page: (id, text), with its url and words of its html."""
    words = F.substring(F.regexp_replace("html", "[^a-z ]+", " "), 1, 40)
    text = F.concat(F.lit("page="), F.col("page_id").cast("string"), F.lit("&from="), F.substring("url", 1, 60), F.lit("&words="), words)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.alias("text"))


def varied_tokens(spark, sf_dir):
    """Every encoding of the varied texts as (token_id, token); those in Base64 in its form without `+`, `/` and `=`."""
    made = decode.encoded(varied(spark, sf_dir)).where(~F.col("variant").startswith("LZ-"))
    bare = F.when(F.col("variant").contains("Base64"), F.translate("value", "+/=", "-_")).otherwise(F.col("value"))
    return made.select(F.concat(F.col("id").cast("string"), F.lit("/"), F.col("variant")).alias("token_id"), bare.alias("token"))


VARIED = r"""WITH pl AS (SELECT page_id, concat('page=', page_id, '&from=', substr(url, 1, 60), '&words=', substr(regexp_replace(html, '[^a-z ]+', ' ', 'g'), 1, 40)) AS x FROM pages)"""
# How each encoding is read, and what else reads it: zlib's first bytes are a UTF-16 LZ-String.
READINGS = """(VALUES ('Base64', 'Base64 text'), ('Base64URL', 'Base64 text'), ('HEX', 'HEX'), ('Base32', 'Base32'), ('Quoted-Printable', 'Quoted-Printable'), """ + ", ".join(
    f"('{c}+Base64', 'Base64 {c}')" for c in codecs.CODECS
) + ") AS v(encoding, variant)"


@query(VARIED + f" SELECT concat(page_id, '/', encoding) AS token_id, variant, x AS value FROM pl, {READINGS} UNION ALL SELECT concat(page_id, '/zlib+Base64'), 'LZ-UTF16', '@@@' FROM pl")
def j5_text_variants(spark, sf_dir):
    """The whole union: every accepted reading of every encoding of a text."""
    return decode.variants(varied_tokens(spark, sf_dir))


@query()
def j5_variant_union(spark, sf_dir):
    return decode.variants(planted_tokens(spark, sf_dir)).groupBy("variant").agg(F.count("*").alias("n"))


# --- decoding --------------------------------------------------------------

TOKENS = r"[A-Za-z0-9_\-+$/=.]{8,}"


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '{TOKENS}')) AS token FROM pages")
def t1_candidates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(decode.candidate_tokens(F.col("html"))).alias("token"))


TOK = f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(html, '{TOKENS}')) AS token FROM pages)"


@query(TOK + r" SELECT token, length(regexp_replace(token, '[^A-Za-z0-9+\-$_.]', '', 'g')) / length(token) >= 0.95 AS uri_safe FROM t")
def t2_uri_safe(spark, sf_dir):
    return t1_candidates(spark, sf_dir).select("token").distinct().select("token", decode.looks_uri_safe(F.col("token")).alias("uri_safe"))


@query(TOK + r" SELECT token, regexp_matches(token, '^[A-Za-z0-9_\-+/]*=*$') AS base64_like FROM t")
def t3_base64_like(spark, sf_dir):
    return t1_candidates(spark, sf_dir).select("token").distinct().select("token", decode.looks_base64(F.col("token")).alias("base64_like"))


@query("SELECT page_id, concat('user=', page_id, '&note=hello world') AS text FROM pages UNION ALL SELECT page_id, url FROM pages")
def t4_base64_decode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    plain = pages.select("page_id", F.concat(F.lit("user="), F.col("page_id").cast("string"), F.lit("&note=hello world")).alias("x")).union(pages.select("page_id", "url"))
    token = F.translate(F.base64(F.col("x").cast("binary")), "+/=\r\n", "-_")
    return plain.select("page_id", surfaces.utf8(decode.base64_bytes(token)).alias("text"))


@query("SELECT page_id, url AS text FROM pages WHERE url IS NOT NULL")
def t5_hex_decode(spark, sf_dir):
    token = F.lower(F.hex(F.col("url").cast("binary")))
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", decode.hex_text(token).alias("text"))


def round_trip(name: str, variant: str, back):
    @query("SELECT page_id, url AS text FROM pages WHERE url IS NOT NULL")
    def run(spark, sf_dir):
        pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
        packed = codecs.encode_udf(variant)(F.col("url"))
        return pages.select("page_id", packed.alias("t")).select("page_id", back(F.col("t")).alias("text"))

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


round_trip("t6_base32", "base32", lambda t: surfaces.utf8(codecs.bytes_udf(codecs.base32_bytes)(t)))
round_trip("t7_quoted_printable", "quoted-printable", lambda t: surfaces.utf8(codecs.bytes_udf(codecs.quoted_printable_bytes)(t)))
for _c in codecs.CODECS:
    _n = "t8" if _c in ("gzip", "zlib", "deflate") else "t9"
    round_trip(f"{_n}_{_c}", _c, lambda t, c=_c: surfaces.utf8(codecs.decompress_udf(c)(F.unbase64(t))))
for _a in ("base64", "uri", "utf16"):
    round_trip(f"t10_lz_{_a}", f"lz-{_a}", lambda t, a=_a: codecs.lz_decode_udf(a)(t))


@query("SELECT doc_id, concat('?', text) AS repaired, text AS untouched FROM documents WHERE NOT contains(text, chr(65533))")
def t11_repair(spark, sf_dir):
    """Texts whose UTF-8 bytes were read as Latin-1 behind a replacement character, repaired; and texts that need none."""
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\ufffd")))
    wrong = F.concat(F.lit("\ufffd"), F.decode(F.col("text").cast("binary"), "ISO-8859-1"))
    return docs.select("doc_id", codecs.repaired_text(wrong).alias("repaired"), codecs.repaired_text(F.col("text")).alias("untouched"))


#: Characters of a page in one text.
PIECE = 1_000


def pieces(spark, sf_dir):
    """All of every page, url and html, in pieces: (id, text); the id is the page and the place, the text begins with both."""
    whole = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    cut = F.posexplode(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("i", "piece")
    page, i = F.col("page_id").cast("string"), F.col("i").cast("string")
    text = F.concat(F.lit("page="), page, F.lit("&piece="), i, F.lit("&text="), "piece")
    return table(spark, sf_dir, "pages").select("page_id", cut).select(F.concat(page, F.lit("/"), i).alias("id"), text.alias("text"))


# The decode job's gate of quality, as over documents in SHARES; what doesn't pass it has no reading.
PIECES = rf"""WITH whole AS (SELECT page_id, concat(coalesce(url, ''), chr(10), coalesce(html, '')) AS w FROM pages),
places AS (SELECT page_id, w, unnest(range((length(w) + {PIECE - 1}) // {PIECE})) AS i FROM whole),
pc AS (SELECT concat(page_id, '/', i) AS id, concat('page=', page_id, '&piece=', i, '&text=', substr(w, {PIECE} * i + 1, {PIECE})) AS x FROM places),
sh AS (SELECT *, length(regexp_replace(x, '[^\x20-\x7E\t\n\r]', '', 'g')) / length(x) AS p, length(regexp_replace(x, '[^\x00-\x7F]', '', 'g')) / length(x) AS a,
  length(regexp_replace(x, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) / length(x) AS c FROM pc),
ok AS (SELECT * FROM sh WHERE p >= 0.90 AND a >= 0.85 AND c <= 0.01 AND (p >= 0.94 OR (instr(x, ':') > 1 AND instr(x, ',') > 1) OR regexp_matches(x, '(?s)^[^@]+@.*\.')))"""


@query(PIECES + """ SELECT concat(id, '/', encoding) AS token_id, route, md5(x) AS decoded FROM ok,
  (VALUES ('Base64', 'base64'), ('Base64URL', 'base64'), ('gzip+Base64', 'gzip'), ('zlib+Base64', 'zlib'), ('deflate+Base64', 'deflate'), ('brotli+Base64', 'brotli'),
  ('lz4+Base64', 'lz4'), ('zstd+Base64', 'zstd'), ('snappy+Base64', 'snappy'), ('LZ-Base64', 'lz-base64'), ('LZ-URI', 'lz-uri')) AS v(encoding, route)""")
def t12_base64_route(spark, sf_dir):
    """The Base64 route of all encodings of all pages' texts, of those too that it can't read: which route, and the MD5 of the text.

    LZ-URI tokens, whose alphabet is another one, go by their own route.
    """
    made = decode.encoded(pieces(spark, sf_dir))
    name = F.concat("id", F.lit("/"), "variant").alias("token_id")
    tokens = made.select(name, F.col("value").alias("token"), (F.col("variant") == "LZ-URI").alias("uri"))
    return decode.route_readings(tokens).select("token_id", "route", F.md5(F.col("decoded").cast("binary")).alias("decoded"))


@query(PLAIN + """ SELECT concat(page_id, '/', variant) AS token_id, route, x AS decoded FROM pl,
  (VALUES ('Base64', 'base64'), ('Base64URL', 'base64'), ('gzip+Base64', 'gzip'), ('zlib+Base64', 'zlib'), ('deflate+Base64', 'deflate'), ('zstd+Base64', 'zstd'),
  ('LZ-Base64', 'lz-base64')) AS v(variant, route)""")
def t12_base64_texts(spark, sf_dir):
    """The Base64 route of tokens that only it can read: route and text of each."""
    kinds = ("Base64", "Base64URL", "gzip+Base64", "zlib+Base64", "deflate+Base64", "zstd+Base64", "LZ-Base64")
    rows = decode.with_routes(planted_tokens(spark, sf_dir).where(F.split("token_id", "/")[1].isin(*kinds)))
    found = decode.first_accepted(F.array("_found"), DECODE)
    return rows.select("token_id", found.alias("f")).select("token_id", "f.*").where("route IS NOT NULL")


@query(PLAIN + " SELECT DISTINCT route, x AS decoded FROM pl, (VALUES ('base64'), ('gzip'), ('zlib'), ('deflate'), ('zstd'), ('lz-base64')) AS v(route)")
def t13_cascade_texts(spark, sf_dir):
    """What the cascade reads from such tokens, of unknown kind."""
    kinds = ("Base64", "Base64URL", "gzip+Base64", "zlib+Base64", "deflate+Base64", "zstd+Base64", "LZ-Base64")
    tokens = planted_tokens(spark, sf_dir).where(F.split("token_id", "/")[1].isin(*kinds))
    return decode.decoded_tokens(tokens.select("token", F.lit(False).alias("whole"))).select("route", "decoded").distinct()


def cascade_tokens(spark, sf_dir):
    """All that there is to decode, as (token, whole): tokens of all surfaces of the planted exchanges, all words of the pages, and every encoding of urls and planted texts."""
    pages = table(spark, sf_dir, "pages")
    met = decode.tokens_of(surfaces.decoding(ex(spark, sf_dir))).select("token", "whole")
    urls = decode.encoded(pages.select(F.col("page_id").alias("id"), F.col("url").alias("text"))).select(F.col("value").alias("token"))
    single = t1_candidates(spark, sf_dir).select("token").union(urls).union(planted_tokens(spark, sf_dir).select("token"))
    return met.union(single.select("token", F.lit(False).alias("whole")))


@query()
def t13_token_cascade(spark, sf_dir):
    """How many distinct tokens of all there are each route reads; null is those that none does."""
    return decode.decoded_tokens(cascade_tokens(spark, sf_dir), unread=True).groupBy("route").agg(F.count("*").alias("n"))


@query(PLAIN + " SELECT x AS decoded, 'lz-uri' AS route FROM pl")
def t14_whole_texts(spark, sf_dir):
    """Whole texts that look URI-safe come back as what they were made of."""
    return t14_whole_surfaces(spark, sf_dir).select("decoded", "route")


@query()
def t14_whole_surfaces(spark, sf_dir):
    rows = planted_tokens(spark, sf_dir).where(F.col("token_id").endswith("/LZ-URI"))
    return decode.decoded_tokens(rows.select("token", F.lit(True).alias("whole"))).select("token", "route", "decoded")


# The Base64-text route over all request surfaces: layers of the url's path, parameters, headers, whole query and body.
REQUESTS = DecodeOptions(min_decoded=4, scan_responses=False)
HITS_SQL = EX + rf""", lay AS (SELECT exchange_id, {PATH} AS x0 FROM ex), l1 AS (SELECT *, {DECODED.format('x0')} AS x1 FROM lay), l2 AS (SELECT *, {DECODED.format('x1')} AS x2 FROM l1),
ly AS (SELECT exchange_id, x0 AS layer FROM l2 UNION SELECT exchange_id, x1 FROM l2 UNION SELECT exchange_id, x2 FROM l2),
sg AS (SELECT exchange_id, string_split(regexp_replace(layer, '^/|/$', '', 'g'), '/') AS parts FROM ly),
pr AS (SELECT exchange_id, 'param-url:' AS pre, unnest(string_split({QUERY}, '&')) AS p FROM ex UNION ALL SELECT exchange_id, 'param-body:', unnest(string_split(req_body, '&')) FROM ex WHERE req_body IS NOT NULL AND contains(req_headers[6], 'form')),
hd AS (SELECT exchange_id, unnest(req_headers) AS h FROM ex),
sf AS (SELECT DISTINCT exchange_id, concat('path-seg[', i, ']') AS origin, parts[i + 1] AS text FROM (SELECT *, unnest(range(len(parts))) AS i FROM sg)
  UNION ALL SELECT exchange_id, concat(pre, {DECODED.format('split_part(p, chr(61), 1)')}), {DECODED.format('substr(p, instr(p, chr(61)) + 1)')} FROM pr WHERE contains(p, '=')
  UNION ALL SELECT exchange_id, concat('raw-query:', left(p, 20)), substr(p, instr(p, '=') + 1) FROM pr WHERE pre = 'param-url:' AND contains(p, '=')
  UNION ALL SELECT exchange_id, concat('param-2:', trim(split_part(c, '=', 1))), substr(c, instr(c, '=') + 1) FROM (SELECT exchange_id, unnest(string_split(substr(h, 9), ';')) AS c FROM hd WHERE starts_with(h, 'Cookie:'))
  UNION ALL SELECT exchange_id, concat('param-6:', j.key), j.atom ->> '$' FROM ex, json_tree(CASE WHEN {JSON_SQL} THEN req_body END) AS j WHERE j.type = 'VARCHAR' AND NOT ends_with(j.fullkey, ']')
  UNION ALL SELECT exchange_id, 'query', {QUERY} FROM ex UNION ALL SELECT exchange_id, 'body', req_body FROM ex
  UNION ALL SELECT exchange_id, concat('header:', split_part(h, ':', 1)), trim(substr(h, instr(h, ':') + 1)) FROM hd WHERE lower(split_part(h, ':', 1)) NOT IN ('cookie', 'user-agent', 'accept-language')),
ch AS (SELECT *, text AS y0, {DECODED.format('text')} AS y1 FROM sf WHERE text <> ''), ch2 AS (SELECT *, {DECODED.format('y1')} AS y2 FROM ch), ch3 AS (SELECT *, {DECODED.format('y2')} AS y3 FROM ch2),
tk AS (SELECT exchange_id, origin, text, unnest(list_concat(list_concat(regexp_extract_all(y0, '{TOKENS}'), regexp_extract_all(y1, '{TOKENS}')), list_concat(regexp_extract_all(y2, '{TOKENS}'), regexp_extract_all(y3, '{TOKENS}')))) AS token,
  unnest(range(len(list_concat(list_concat(regexp_extract_all(y0, '{TOKENS}'), regexp_extract_all(y1, '{TOKENS}')), list_concat(regexp_extract_all(y2, '{TOKENS}'), regexp_extract_all(y3, '{TOKENS}')))))) AS rank FROM ch3),
nm AS (SELECT *, translate(token, '-_=', '+/') AS bare FROM tk WHERE regexp_matches(token, '^[A-Za-z0-9_\-+/=]{{8,}}$') AND regexp_matches(token, '^[^=]*=*$')),
by64 AS (SELECT *, try(from_base64(rpad(bare, CAST(ceil(length(bare) / 4.0) * 4 AS INT), '='))) AS b FROM nm WHERE length(bare) % 4 <> 1),
tx AS (SELECT *, try(decode(b)) AS decoded FROM by64 WHERE rtrim(to_base64(b), '=') = bare),
sh AS (SELECT *, length(decoded) AS n, length(regexp_replace(decoded, '[^\x20-\x7E\t\n\r]', '', 'g')) / length(decoded) AS p FROM tx WHERE length(decoded) >= 4),
ok AS (SELECT * FROM sh WHERE p >= 0.94 OR (p >= 0.90 AND (starts_with(decoded, 'http') OR (instr(decoded, ':') > 1 AND instr(decoded, ',') > 1)))),
hit AS (SELECT DISTINCT exchange_id, origin, token, decoded FROM ok QUALIFY row_number() OVER (PARTITION BY exchange_id, origin, text ORDER BY rank) = 1)"""


@query(HITS_SQL + " SELECT exchange_id, origin, token, 'base64' AS route, decoded FROM hit")
def t15_request_hits(spark, sf_dir):
    """The decode job over requests: the first accepted token of every surface."""
    return audit.decode_job(ex(spark, sf_dir), REQUESTS).select("exchange_id", "origin", "token", "route", "decoded")


@query(HITS_SQL + ' SELECT row_number() OVER (ORDER BY exchange_id, origin, token, decoded) AS "row", origin, length(token) AS token_len, decoded, token FROM hit')
def s5_request_export(spark, sf_dir):
    rows = sinks.export(audit.decode_job(ex(spark, sf_dir), REQUESTS))
    return rows.select("row", "origin", "token_len", "decoded", "token")


@query(HITS_SQL + " SELECT exchange_id, origin, token, 'base64' AS route, decoded FROM hit")
def st2_live_requests(spark, sf_dir):
    """The decode job over requests as they arrive: what the batch job finds."""
    out = folder(spark)
    live.write_live_tokens(stream(spark, sf_dir), f"{out}/rows", f"{out}/state", REQUESTS).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("exchange_id", "origin", "token", "route", "decoded")


def answered(rows: DataFrame) -> DataFrame:
    """Exchanges whose responses hold one known token each, escaped in every third."""
    plain = F.concat(F.lit("page="), F.col("exchange_id").cast("string"), F.lit("&from="), F.substring("url", 1, 60))
    token = F.translate(F.base64(plain.cast("binary")), "+/=\r\n", "-_")
    shown = F.when(F.col("exchange_id") % 3 == 0, F.regexp_replace(F.hex(token.cast("binary")), "(..)", "%$1")).otherwise(token)
    body = F.concat(F.lit("<p> id "), shown, F.lit(" </p>")).cast("binary")
    return rows.withColumn("resp_body", F.when(F.col("resp_headers").isNotNull(), body))


ANSWERS_SQL = EX + f""", an AS (SELECT exchange_id, {TYPE} AS kind, concat('page=', exchange_id, '&from=', substr(url, 1, 60)) AS decoded FROM ex WHERE resp_headers IS NOT NULL)
SELECT exchange_id, 'resp-body' AS origin, rtrim(translate(to_base64(encode(decoded)), '+/', '-_'), '=') AS token, 'base64' AS route, decoded FROM an WHERE {ALLOWED}"""


@query(ANSWERS_SQL)
def t15_response_hits(spark, sf_dir):
    """The decode job over responses with known tokens."""
    found = audit.decode_job(answered(ex(spark, sf_dir)), DecodeOptions(min_decoded=4))
    return found.where("direction = 'response'").select("exchange_id", "origin", "token", "route", "decoded")


@query(ANSWERS_SQL)
def st2_live_responses(spark, sf_dir):
    """The same responses as they arrive."""
    out = folder(spark)
    live.write_live_tokens(answered(stream(spark, sf_dir)), f"{out}/rows", f"{out}/state", DecodeOptions(min_decoded=4)).awaitTermination()
    return spark.read.parquet(f"{out}/rows").where("direction = 'response'").select("exchange_id", "origin", "token", "route", "decoded")


@query()
def t15_first_hits(spark, sf_dir):
    return audit.decode_job(ex(spark, sf_dir), DecodeOptions(min_decoded=4))


@query(VARIED + f""" SELECT concat(page_id, '/', encoding) AS token_id, variant, x AS value FROM pl, {READINGS} UNION ALL SELECT concat(page_id, '/zlib+Base64'), 'LZ-UTF16', '@@@' FROM pl
UNION ALL SELECT concat('page ', page_id), 'No decode', '' FROM pages""")
def t16_hex_or_none(spark, sf_dir):
    """The report over every encoding of varied texts, and over tokens that no route can read: all rows."""
    dull = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("token_id"), F.lit("\x01\x02").alias("token"))
    return decode.variants(varied_tokens(spark, sf_dir).unionByName(dull))


@query()
def t16_all_variants(spark, sf_dir):
    return decode.variants(planted_tokens(spark, sf_dir))


@query(PLAIN + " SELECT concat(page_id, '/', variant) AS token_id, x AS decoded FROM pl, (VALUES ('LZ-Base64'), ('LZ-URI')) AS v(variant)")
def t13_older_texts(spark, sf_dir):
    """What the older routes read from LZ-String tokens: URI-safe first, so most Base64 ones go that way too."""
    tokens = planted_tokens(spark, sf_dir).where(F.split("token_id", "/")[1].isin("LZ-Base64", "LZ-URI"))
    found = decode.decoded_tokens(tokens.select("token", F.lit(False).alias("whole")), OLDER_DECODE)
    return tokens.join(found, "token").select("token_id", "decoded")


@query(EX + """ SELECT exchange_id, origin, 'lz-uri' AS route, concat('user=', exchange_id, '&note=hello world') AS decoded
  FROM ex, (VALUES ('header:X-State-EU-fast'), ('header:X-Escaped-EU-fast-dec1')) AS v(origin)""")
def t15_older_hits(spark, sf_dir):
    """The decode job as the older version runs it, over exchanges with two more headers: a token, and the same token escaped."""
    plain = F.concat(F.lit("user="), F.col("exchange_id").cast("string"), F.lit("&note=hello world"))
    rows = ex(spark, sf_dir).withColumn("_token", codecs.encode_udf("lz-uri")(plain))
    escaped = F.regexp_replace(F.hex(F.col("_token").cast("binary")), "(..)", "%$1")
    more = F.array(F.concat(F.lit("X-State: "), F.col("_token")), F.concat(F.lit("X-Escaped: "), escaped))
    rows = rows.withColumn("req_headers", F.concat("req_headers", more)).drop("_token")
    return audit.decode_job(rows, OLDER_DECODE).select("exchange_id", "origin", "route", "decoded")


@query(PLAIN + """ SELECT concat(page_id, '/LZ-URI') AS token_id, 'lz-uri' AS route, x AS value FROM pl
  UNION ALL SELECT concat('page ', page_id), 'No decode', '' FROM pages""")
def t16_first_readings(spark, sf_dir):
    """The older report on LZ-String tokens and on tokens without any reading."""
    rows = planted_tokens(spark, sf_dir).where(F.split("token_id", "/")[1] == "LZ-URI")
    dull = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("token_id"), F.lit("\x01\x02").alias("token"))
    return decode.first_readings(rows.unionByName(dull))


# Base32 by the bits of hex digits, five at a time.
@query("""WITH p AS (SELECT page_id AS id, url AS text FROM pages WHERE url IS NOT NULL),
b AS (SELECT id, array_to_string(list_transform(string_split(hex(encode(text)), ''), lambda x: lpad(bin(CAST(instr('0123456789ABCDEF', x) - 1 AS INT)), 4, '0')), '') AS bits FROM p),
g AS (SELECT id, list_transform(range(1, length(bits) + 1, 5), lambda i: rpad(substr(bits, i, 5), 5, '0')) AS fives FROM b)
SELECT id, 'Base64' AS variant, to_base64(encode(text)) AS value FROM p UNION ALL SELECT id, 'Base64URL', translate(to_base64(encode(text)), '+/=', '-_') FROM p
UNION ALL SELECT id, 'HEX', hex(encode(text)) FROM p UNION ALL SELECT id, 'Quoted-Printable', replace(text, '=', '=3D') FROM p
UNION ALL SELECT id, 'Base32', array_to_string(list_transform(fives, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(f[1] AS INT) + 8 * CAST(f[2] AS INT) + 4 * CAST(f[3] AS INT) + 2 * CAST(f[4] AS INT) + CAST(f[5] AS INT), 1)), '') FROM g""")
def t17_encode(spark, sf_dir):
    """The encodings without a codec."""
    plain = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    return decode.encoded(plain).where(F.col("variant").isin("Base64", "Base64URL", "HEX", "Quoted-Printable", "Base32"))


SHARES = r"""WITH s AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\x20-\x7E\t\n\r]', '', 'g')) / length(text) AS p,
length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) AS a, length(regexp_replace(text, '[^\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) / length(text) AS c,
trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents WHERE length(text) > 0),
g AS (SELECT *, (starts_with(t, '{') AND ends_with(t, '}')) OR (starts_with(t, '[') AND ends_with(t, ']')) OR starts_with(t, 'http://') OR starts_with(t, 'https://')
 OR (instr(t, ':') > 1 AND instr(t, ',') > 1) OR regexp_matches(t, '(?s)^[^@]+@.*\.') AS structured FROM s),
q AS (SELECT *, p >= 0.90 AND a >= 0.85 AND c <= 0.01 AND (structured OR p >= 0.94) AS passes FROM g)"""


@query(SHARES + " SELECT doc_id, structured, passes FROM q")
def q1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    text = F.col("text")
    return docs.select("doc_id", quality.looks_structured(text).alias("structured"), quality.passes(text, DECODE).alias("passes"))


@query(r"""WITH b AS (SELECT page_id, concat('{', repeat('}', CAST(page_id % 6 AS INT)), substr(html, 1, 40), repeat('{', CAST(page_id % 3 AS INT)), '}') AS t FROM pages),
c AS (SELECT page_id, regexp_replace(t, '[^{}]', '', 'g') AS s FROM b), d AS (SELECT page_id, s, unnest(range(1, length(s) + 1)) AS i FROM c),
w AS (SELECT page_id, min(2 * length(replace(left(s, i), '}', '')) - i) AS low FROM d GROUP BY page_id)
SELECT page_id, low >= -2 OR (instr(t, ':') > 1 AND instr(t, ',') > 1) OR regexp_matches(t, '(?s)^[^@]+@.*\.') AS structured FROM w JOIN b USING (page_id)""")
def q1_brace_balance(spark, sf_dir):
    """The older gate's test of braces, on texts between braces that close too often in every second."""
    n = F.col("page_id")
    text = F.concat(F.lit("{"), F.repeat(F.lit("}"), (n % 6).cast("int")), F.substring("html", 1, 40), F.repeat(F.lit("{"), (n % 3).cast("int")), F.lit("}"))
    return table(spark, sf_dir, "pages").select("page_id", quality.looks_structured(text, brace_balance=True).alias("structured"))


@query(SHARES + " SELECT doc_id, c <= 0.05 AND p >= 0.70 AS readable FROM q")
def q2_readable(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", quality.readable(F.col("text")).alias("readable"))


@query(SHARES + " SELECT doc_id, passes AND n <= 16384 AND c <= 0.05 AND p >= 0.70 AS accepted FROM q")
def q3_accept(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", quality.accepted(F.col("text"), DECODE).alias("accepted"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(left(text, 47), '...') ELSE text END AS preview FROM documents")
def r1_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", decode.preview(F.col("text")).alias("preview"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS detail, count(*) OVER () AS created FROM pages")
def r2_issue_rows(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", decode.escaped(F.col("html")).alias("detail"))
    return pages.crossJoin(F.broadcast(pages.agg(F.count("*").alias("created"))))  # one row


# --- streaming -------------------------------------------------------------


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted exchanges of the pages, read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/pages.parquet").schema
    # A pattern, as the table may be one file: a stream reads folders and patterns.
    pages = spark.readStream.schema(schema).parquet(f"{sf_dir}/pages.parque[t]").select("page_id", "url", "html")
    text = source.planted_sql(source.SPARK).replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql(text, pages=pages)


def folder(spark: SparkSession) -> str:
    return tables.shared_folder(spark, "stream")


@query(FIND_SQL + " SELECT url, title, detail, kind FROM found")
def st1_live_findings(spark, sf_dir):
    out = folder(spark)
    live.write_live_findings(stream(spark, sf_dir), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("url", "title", "detail", "kind")


@query()
def st2_live_tokens(spark, sf_dir):
    out = folder(spark)
    live.write_live_tokens(stream(spark, sf_dir), f"{out}/rows", f"{out}/state", DecodeOptions(min_decoded=4)).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query(FIND_SQL + " SELECT DISTINCT value FROM found")
def st3_live_distinct(spark, sf_dir):
    out = folder(spark)
    rows = live.distinct_values(live.live_findings(stream(spark, sf_dir)), "365 days")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").outputMode("append")
    writer.trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("value")


HIT_INPUTS = "inputs WHERE exchange_id IN (SELECT exchange_id FROM found) AND length(value) BETWEEN 1 AND 4096"


@query(FIND_SQL + INPUTS_SQL + f" SELECT DISTINCT 'hash' AS what, '' AS name, value FROM found UNION ALL SELECT DISTINCT 'input', name, value FROM {HIT_INPUTS}")
def st3_live_memory(spark, sf_dir):
    """First sightings of hashes and inputs, by keyed state."""
    out = folder(spark)
    live.write_live_captures(stream(spark, sf_dir), out, f"{out}/state", ttl=timedelta(days=3650)).awaitTermination()
    hashes = live.committed(spark, out, "hashes").select(F.lit("hash").alias("what"), F.lit("").alias("name"), "value")
    return hashes.unionByName(live.committed(spark, out, "inputs").select(F.lit("input").alias("what"), F.col("param_name").alias("name"), "value"))


@query(FIND_SQL + INPUTS_SQL + f""" SELECT 'finding' AS what, title AS name, value, detail, NULL::TIMESTAMP AS ts FROM found
UNION ALL SELECT 'hash', NULL, value, NULL, min(ts) FROM found GROUP BY value UNION ALL SELECT 'input', name, value, NULL, min(ts) FROM {HIT_INPUTS} GROUP BY name, value""")
def w2_live_capture(spark, sf_dir):
    """Capture as exchanges arrive: what the batch job gives, from committed micro-batches."""
    out = folder(spark)
    live.write_live_captures(stream(spark, sf_dir), out, f"{out}/state").awaitTermination()
    none, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp").alias("ts")
    found = live.committed(spark, out, "findings").select(F.lit("finding").alias("what"), F.col("title").alias("name"), "value", "detail", never)
    hashes = live.committed_hashes(spark, out).select(F.lit("hash").alias("what"), none.alias("name"), "value", none.alias("detail"), "ts")
    inputs = live.committed_inputs(spark, out).select(F.lit("input").alias("what"), F.col("param_name").alias("name"), "value", none.alias("detail"), "ts")
    return found.unionByName(hashes).unionByName(inputs)


@query(FIND_SQL + INPUTS_SQL + " SELECT name AS param_name, value, min(ts) AS ts FROM inputs WHERE exchange_id IN (SELECT exchange_id FROM found) GROUP BY 1, 2")
def w2_capture(spark, sf_dir):
    return audit.capture_job(ex(spark, sf_dir), DETECT, CaptureOptions())[1]
