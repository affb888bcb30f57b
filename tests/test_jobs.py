import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wiresift import queries, schema
from wiresift.functions import digests, gates, quality
from wiresift.jobs import audit
from wiresift.operators import capture, decode, detect, surfaces
from wiresift.options import OLDER_DECODE, DecodeOptions, DetectOptions
from wiresift.sources import exchanges, sinks

SF = "/root/testdata/sf0.001"
MD5, SHA1 = hashlib.md5(b"x").hexdigest(), hashlib.sha1(b"x").hexdigest()


def value(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


#: One query of each kind; the driver compares all of them.
SAMPLE = ["s2_value_lines", "f1_skip_assets", "f6_scope", "f7_noisy_headers", "p2_url_parts", "p4_decode_chain", "p13_surface_union",
          "d5_entropy", "d10_local_context", "d13_findings", "d14_distinct_findings", "j2_distinct_inputs", "j4_match_hashes",
          "t4_base64_decode", "t10_lz_uri", "t13_older_texts", "t15_older_hits", "t16_first_readings", "q1_quality", "st1_live_findings", "w2_capture"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    with duckdb.connect() as db:
        for t in ("pages", "documents", "conversations", "events"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = db.execute(queries.SQL[name])
        columns, rows = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([value(dict(zip(columns, r))[c]) for c in sorted(columns)]) for r in rows)
    assert sorted(repr([value(r[c]) for c in sorted(columns)]) for r in got.collect()) == want


def exchange(spark, *rows):
    base = dict(exchange_id=1, ts=None, tool="t", method="GET", url="https://a.example/x", req_headers=[], req_body=None, resp_headers=None, resp_body=None)
    made = [tuple({**base, "exchange_id": i, **r}.values()) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, schema.EXCHANGES)


def test_missing_parts_and_empty_tables(spark):
    rows = exchange(spark, dict(url=None, method=None), dict(resp_headers=["Content-Type: text/html"], resp_body=b""))
    assert audit.detect_job(rows).count() == 0
    assert audit.decode_job(rows).count() == 0
    none = rows.where("false")
    hashes, inputs = audit.capture_job(none)
    assert hashes.count() == 0 and inputs.count() == 0


def test_bad_utf8_and_packed_bodies(spark):
    import gzip

    packed = gzip.compress(f"token {MD5} end".encode())
    rows = exchange(
        spark,
        dict(resp_headers=["Content-Type: text/html", "Content-Encoding: gzip"], resp_body=packed),
        dict(url="https://a.example/y", resp_headers=["Content-Encoding: gzip"], resp_body=b"\xff\xfe " + MD5.encode()),
    )
    found = {(r["exchange_id"], r["value"]) for r in audit.detect_job(rows).collect()}
    assert found == {(0, MD5), (1, MD5)}


def test_thresholds(spark):
    def run(text, **options):
        rows = spark.createDataFrame([(1, "u", "response-body", text)], "exchange_id long, url string, location string, text string")
        return [r["value"] for r in detect.findings(rows, DetectOptions(**options)).where("kind = 'hex'").collect()]

    assert run(f"a {MD5} b") == [MD5]
    assert run(MD5[:31] + " " + "ab" * 16 + " deadbeef") == []
    assert run("0" * 257) == [] and run(MD5, entropy=4.5) == []
    assert run(SHA1 + SHA1[:8], strict=True) == []  # an unusual length without a keyword near
    assert run("digest " + SHA1 + SHA1[:8], strict=True) == [SHA1 + SHA1[:8]]
    assert set(run(f"{MD5} {SHA1}", strict=True)) <= set(run(f"{MD5} {SHA1}"))


def test_entropy_of_exactly_the_threshold_passes(spark):
    flat = "".join(f"{i:02x}" for i in range(12)) + "00010203"  # 16 bytes, four of them twice
    row = spark.range(1).select(digests.entropy(digests.byte_pairs(F.lit(flat))).alias("e")).first()
    assert row["e"] == 3.5


def test_multipart_and_duplicate_parameters(spark):
    body = b'--B\r\nContent-Disposition: form-data; name="a"\r\n\r\n v \r\n--B\r\nContent-Disposition: form-data; name="f"; filename="x"\r\n\r\nfile\r\n--B--\r\n'
    rows = exchange(
        spark,
        dict(method="POST", req_headers=['Content-Type: multipart/form-data; boundary="B"'], req_body=body),
        dict(url="https://a.example/x?k=1&k=2&k=%zz&e=&n"),
    )
    got = sorted((r["exchange_id"], r["name"], r["value"]) for r in capture.inputs(rows).collect())
    assert got == [(0, "a", "v"), (1, "k", "%zz"), (1, "k", "1"), (1, "k", "2")]


def test_decode_routes(spark):
    plain = spark.createDataFrame([(1, "user=admin; role=operator")], "id long, text string")
    tokens = decode.encoded(plain).select(F.col("variant").alias("token_id"), F.col("value").alias("token"))
    got = {(r["token_id"], r["value"]) for r in decode.variants(tokens).collect()}
    for variant in ("Base64", "HEX", "Base32", "gzip+Base64", "zstd+Base64", "LZ-Base64", "LZ-URI"):
        assert (variant, "user=admin; role=operator") in got


def test_first_hit_only_once(spark):
    rows = exchange(spark, dict(url="https://a.example/p?x=dXNlcj1hZG1pbiZyb2xlPW9w&y=dXNlcj1hZG1pbiZyb2xlPW9w"))
    got = audit.decode_job(rows, DecodeOptions(min_decoded=4)).where("origin LIKE 'param-url:%'").collect()
    assert sorted((r["origin"], r["decoded"]) for r in got) == [("param-url:x", "user=admin&role=op"), ("param-url:y", "user=admin&role=op")]


def test_gates_and_quality(spark):
    row = spark.range(1).select(
        gates.is_blocked_type(F.lit("application/vnd.api+json")).alias("a"),
        gates.is_blocked_type(F.lit(None).cast("string")).alias("b"),
        gates.is_asset(F.lit("https://a/x.JS?y")).alias("c"),
        quality.accepted(F.lit(""), DecodeOptions()).alias("d"),
        quality.looks_structured(F.lit(" {a} "), True).alias("e"),
        quality.looks_structured(F.lit("{}}}}"), True).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, False, True, False)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb",), ('q"x',)], "value string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    sinks.write_values(rows, str(tmp_path / "v"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()) == ["a\\nb", 'q"x']
    sinks.write_csv(rows, str(tmp_path / "c"), "value")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert sorted(r["value"] for r in back.collect()) == ["a\nb", 'q"x']


def test_surfaces_keep_duplicates_apart(spark):
    got = surfaces.decoding(exchanges.planted(spark, SF)).groupBy("exchange_id", "ordinal").count().where("count > 1")
    assert got.isEmpty()


@pytest.mark.parametrize("name", ["d7_english", "p5_path_segments", "s1_read_exchanges", "t16_hex_or_none", "t15_response_hits", "p8_typed_surfaces"])
def test_whole_query_equals_sql(spark, name):
    test_query_equals_sql(spark, name)


def test_english_is_judged_over_the_whole_text(spark):
    prose, junk = "the old river runs under the stone bridge ", "\x01\x02#$|9 "
    texts = [prose * 9, prose * 3 + junk * 90, junk * 9 + prose * 300, "a b", "abc", "", None, "\n" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["english"] for r in queries.whole_english(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [True, False, True, True, False, False, False, False]


def test_all_path_layers_are_segmented(spark):
    got = {(r["location"], r["text"]) for r in queries.p5_path_segments(spark, SF).where("exchange_id % 12 = 9").collect()}
    assert {("path-seg[1]", "%2541dmin%252Fpanel"), ("path-seg[1]", "%41dmin%2Fpanel"), ("path-seg[1]", "Admin"), ("path-seg[2]", "panel")} <= got


def test_context_of_all_surfaces_and_lengths(spark):
    rows = queries.d10_local_context(spark, SF).collect()
    assert len({r["location"] for r in rows}) > 3 and min(len(r["value"]) for r in rows) == 8


def test_captured_hashes_match_captured_inputs(spark):
    made = {(a, v): hashlib.new(a, v.encode()).hexdigest() for a in capture.DIGESTS for v in ("secret one", "x-2", "never sent")}
    body = " ".join(f"k {h.upper() if i % 2 else h}" for i, h in enumerate(made.values())).encode()
    rows = exchange(spark, dict(resp_headers=["Content-Type: text/html"], resp_body=body), dict(url="https://a.example/x?a=secret+one&b=x-2&c=other"))
    found = capture.distinct_hashes(detect.findings(surfaces.detection(rows)))
    got = {(r["hash"].lower(), r["algorithm"], r["plain"]) for r in capture.matched(found, capture.distinct_inputs(capture.inputs(rows))).collect()}
    assert got == {(h, a, v) for (a, v), h in made.items() if v != "never sent"}


def test_planted_captures_are_matched_whole(spark):
    hashes, inputs = ([r["value"] for r in queries.QUERIES[q](spark, SF).collect()] for q in ("j1_distinct_hashes", "j2_distinct_inputs"))
    want = {(h, a, v) for a in capture.DIGESTS for v in inputs for h in hashes if h.lower() == hashlib.new(a, v.encode()).hexdigest()}
    assert {tuple(r) for r in queries.j4_match_hashes(spark, SF).select("hash", "algorithm", "plain").collect()} == want
    assert want


def test_live_tokens_equal_batch(spark):
    live, batch = (queries.QUERIES[q](spark, SF) for q in ("st2_live_tokens", "t15_first_hits"))
    columns = sorted(set(batch.columns) - {"batch"})
    got, want = (sorted(map(repr, map(tuple, d.select(*columns).collect()))) for d in (live, batch))
    assert got == want and want


def test_repair_expression_equals_helper(spark):
    from wiresift.functions import codecs

    texts = ["plain", "Ã©\ufffd", "\ufffdÃ\x28 é猫", "a 😀 \ufffd", "é", "", None, "\ufffd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", codecs.repaired_text(F.col("t")).alias("r"))
    assert {r["i"]: r["r"] for r in rows.collect()} == {i: codecs.repaired(t) for i, t in enumerate(texts)}


def test_older_version(spark):
    from wiresift.functions import codecs

    plain = "user=admin; role=operator"
    token, wide = codecs.lz_encode(plain, "uri"), codecs.lz_encode(plain, "utf16")
    escaped = "".join(f"%{ord(c):02x}" for c in token)
    rows = exchange(
        spark,
        dict(req_headers=[f"X-A: {token}", f"X-B: {escaped}", f"X-C: <<<<!!!!>>>> {escaped}", f"X-D: (((!!!! {token}", "X-E: dXNlcj1hZG1pbiZyb2xlPW9w"]),
        dict(resp_headers=["Content-Type: text/html"], resp_body=token.encode()),
        dict(method="POST", req_headers=["Content-Type: text/plain"], req_body=token.encode()),
    )
    older = audit.decode_job(rows, OLDER_DECODE)
    got = {(r["exchange_id"], r["origin"], r["token"], r["route"]) for r in older.where(F.col("decoded") == plain).collect()}
    origins = ("header:X-A-EU-fast", "header:X-B-EU-fast-dec1", "header:X-C-dec1", "header:X-D")
    assert got == {(0, o, token, "lz-uri") for o in origins} | {(2, "body-EU-fast", token, "lz-uri")}
    assert older.where("origin LIKE 'header:X-E%' OR direction = 'response'").isEmpty()
    newer = {(r["exchange_id"], r["origin"]) for r in audit.decode_job(rows).where(F.col("decoded") == plain).collect()}
    assert newer == {(0, o.removesuffix("-dec1")) for o in origins} | {(1, "resp-body-EU-fast")}

    tokens = spark.createDataFrame([("u", f" {token} "), ("w", wide), ("n", "\x01\x02"), ("e", ""), ("0", None)], "token_id string, token string")
    readings = {r["token_id"]: (r["route"], r["value"]) for r in decode.first_readings(tokens).collect()}
    none = ("No decode", "")
    assert readings == {"u": ("lz-uri", plain), "w": ("lz-utf16", plain), "n": none, "e": none, "0": none}


def test_older_routes_by_class(spark):
    from wiresift.functions import codecs

    notes = [f"item={i}&state=open; owner=team {i * 7919}" for i in range(60)]
    made = {codecs.lz_encode(t, a): t for t in notes for a in ("uri", "base64")}
    tokens = spark.createDataFrame([(t, False) for t in made], "token string, whole boolean")
    got = {r["token"]: (r["route"], r["decoded"]) for r in decode.decoded_tokens(tokens, OLDER_DECODE).collect()}
    assert {t: d for t, (_, d) in got.items()} == made

    def first(t):  # `/` is no URI-safe character and reads as nothing; with too many of `/` and `=` that route is not tried
        return "lz-base64" if "/" in t or sum(map(t.count, "/=")) > 0.05 * len(t) else "lz-uri"

    assert all(r == first(t) for t, (r, _) in got.items())
    assert {r for r, _ in got.values()} == {"lz-uri", "lz-base64"}


def test_parameters_of_all_types_in_both_jobs(spark):
    digest = hashlib.sha256(b"p").hexdigest()
    token = "dXNlcj1hZG1pbiZyb2xlPW9w"
    xml = ["Content-Type: application/xml"], f"<a k='{digest}'><t>{token}</t></a>".encode()
    json = ["Content-Type: text/plain"], f'{{"t": "{token}", "d": {{"k": "{digest}"}}, "n": [1, "{digest}"]}}'.encode()
    form = ['Content-Type: multipart/form-data; boundary="B"'], f'--B\r\nContent-Disposition: form-data; name="t"\r\n\r\n{token}\r\n--B--'.encode()
    blocked = ["Content-Type: image/png"], f"<a>{digest}</a>".encode()
    made = [dict(method=m, req_headers=h, req_body=b) for m, (h, b) in (("GET", xml), ("POST", json), ("POST", form), ("POST", blocked))]
    rows = exchange(spark, *made)
    found = detect.findings(surfaces.detection(rows))
    assert {(r["exchange_id"], r["location"]) for r in found.collect()} == {
        (0, "body-param:k"), (1, "body-param:k"), (1, "request-body"), (1, "request-body-json:key:d:key:k"),
    }
    hits = audit.decode_job(rows, DecodeOptions(min_decoded=10)).where(F.col("decoded") == "user=admin&role=op")
    got = {(r["exchange_id"], r["origin"]) for r in hits.collect()}
    assert got >= {(0, "param-3:t"), (1, "param-6:t"), (2, "param-5:t")}
    params = {(r["exchange_id"], r["ptype"], r["name"]) for r in capture.inputs(rows).collect()}
    assert params == {(0, "xml-attr", "k"), (0, "xml", "t"), (1, "json", "t"), (1, "json", "k"), (2, "multipart", "t")}


def test_english_of_texts_and_of_their_bytes(spark):
    """Counting characters gives what the list of bytes gives, vowels or not, at any length."""
    made = ["plain english text of some words", "zzz bcd fgh klm " * 9, "aeiou aeiou aeiou", "ünïcödé words and some more of them", "x" * 50, " ", "\x01\x02 abc", "a b\n" * 50_000, "12 34 ab"]
    rows = spark.createDataFrame([(t,) for t in [*made, "", None]], "text string")
    pairs = F.regexp_extract_all(F.lower(F.hex(F.col("text").cast("binary"))), F.lit(".."), F.lit(0))
    both = [c for v in (False, True) for c in (digests.text_looks_english(F.col("text"), v), digests.looks_like_english(pairs, v))]
    got = [tuple(bool(x) for x in r) for r in rows.select(*both).collect()]
    assert all(a == b and c == d for a, b, c, d in got) and len(set(got)) == 3
    plan = queries.QUERIES["d7_vowel_check"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "hex(" not in plan and "regexp_extract_all" not in plan
