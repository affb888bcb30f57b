"""Batch LZ-String and the cascade's reader against the plain decoder and the column expressions."""

import random
import string
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiresift.functions import codecs, lzbatch, quality, routes
from wiresift.operators import decode
from wiresift.options import OLDER_DECODE, DecodeOptions

ALPHABETS = ("base64", "uri", "utf16")
ANY = st.text(st.characters(codec="utf-8"), max_size=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(ANY, st.text(string.ascii_letters + string.digits + "+-$/= ", max_size=90), st.none()), max_size=40), st.integers(1, 300))
def test_batches_equal_the_plain_decoder(texts, cap):
    made = [codecs.lz_encode(t, a) for t in texts if t for a in ALPHABETS]
    cut = [m[: len(m) // 2] for m in made] + [m[:3] + m[4:] for m in made]
    for alphabet in ALPHABETS:
        tokens = [*texts, *made, *cut]
        assert lzbatch.decode(tokens, alphabet, cap) == [codecs.lz_decode(t, alphabet, cap) for t in tokens]


def stream_of(*parts):
    """A token of the Base64 alphabet from (number, bits) pairs, least significant bit first."""
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in parts)
    bits += "0" * (-len(bits) % 6)
    return "".join(codecs.BASE64[int(bits[i : i + 6], 2)] for i in range(0, len(bits), 6))


def test_streams_made_by_hand():
    """Codes written down from the format, not by our encoder."""
    end = 2
    streams = {
        stream_of((0, 2), (ord("a"), 8), (end, 3)): "a",
        stream_of((1, 2), (0x732B, 16), (end, 3)): "猫",
        stream_of((0, 2), (ord("a"), 8), (4, 3), (5, 3), (end, 3)): "aaaaaa",  # each code names the phrase that is being made
        stream_of((0, 2), (ord("a"), 8), (0, 3), (ord("b"), 8), (5, 3), (end, 4)): "abab",
        stream_of((0, 2), (ord("a"), 8), (6, 3)): None,  # a phrase that isn't there
        stream_of((0, 2), (ord("a"), 8)): None,  # no end
        stream_of((end, 2)): "",
        stream_of((3, 2), (5, 8)): None,
    }
    assert [codecs.lz_decode(t, "base64") for t in streams] == list(streams.values())
    assert lzbatch.decode(list(streams) * 30, "base64") == list(streams.values()) * 30
    known = {"base64": "BYUwNmD2A0AECWsCGBbZtDUzkA==", "uri": "BYUwNmD2A0AECWsCGBbZtDUzkA$$"}
    for alphabet, token in known.items():
        assert lzbatch.decode([token, None, ""], alphabet) == ["hello, i am a 猫", None, None]


def test_long_streams_and_the_cap():
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(9000))
    tokens = [codecs.lz_encode(t) for t in (long, "x" * 40_000, "x" * 16_384, "ab" * 8_193)]
    assert lzbatch.decode(tokens, "base64") == [long, None, "x" * 16_384, None]
    junk = codecs.lz_encode(long) + "A" * 300_000  # what follows the end doesn't count
    assert lzbatch.decode([junk], "base64") == [long]


TEXTS = [
    "plain words of a note", "", "{}", "{", "[1, 2]", "a:b,c", "http://x", "me@host.example", "\x00\x01\x02", "café crème", "�" * 9, "x" * 20_000, "tab\tnew\nline",
    "{" + "}" * 5 + "}", " {a} ", "猫" * 20, "mostly plain \x01 words here and there and everywhere, all over: this", "ab\x00", "a", "1234567é",
]


@pytest.mark.parametrize("options", [DecodeOptions(), DecodeOptions(strict=False), DecodeOptions(readable_only=False, min_decoded=4), OLDER_DECODE])
def test_reader_equals_the_columns(spark, options):
    rng = random.Random(3)
    made = TEXTS + ["".join(rng.choice("ab é\x01{}:,") for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in made], "t string")
    reader, t = routes.Reader(options), F.col("t")
    for r in rows.select("t", F.coalesce(quality.passes(t, options), F.lit(False)).alias("p"), quality.accepted(t, options).alias("a")).collect():
        assert (reader.passes(r["t"]), reader.accepts(r["t"])) == (r["p"], r["a"]), r["t"]

    notes = [f"item={i}&state=open; {'owner' * (i % 4)}" for i in range(25)]
    tokens = [x for n in notes for x in (codecs.lz_encode(n), codecs.lz_encode(n, "uri"), codecs.lz_encode(n, "utf16"))]
    import base64

    packed = [codecs.compress(n.encode(), c) for n in notes[:6] for c in codecs.CODECS] + [n.encode() for n in notes] + [rng.randbytes(rng.randrange(4, 40)) for _ in range(60)]
    tokens += [base64.b64encode(p).decode().translate(str.maketrans(*m)) for p in packed for m in (("", ""), ("+/", "-_"))]
    tokens += [t.rstrip("=") for t in tokens] + [t[:-1] for t in tokens[:50]] + ["abc=defgh", "=======a", "a" * 9, "word.word.word", "A-B_C+D/E$F=", "ab=cdefg=="]
    tokens += ["".join(rng.choice(string.ascii_letters + "+-$/=._") for _ in range(rng.randrange(8, 30))) for _ in range(150)]
    rows = decode.with_routes(spark.createDataFrame([(x,) for x in dict.fromkeys(tokens)], "token string"), options)
    uri = decode.looks_uri_safe(F.col("token"), options)
    shape = decode.base64_shape(F.col("token"), options)
    like = decode.looks_base64(F.col("token"), options.min_token)
    kinds = [uri.alias("uri"), shape.alias("shape"), like.alias("like")]
    got = reader.read([(x, False) for x in dict.fromkeys(tokens)])
    for r in rows.select("token", "_uri", "_utf16", "_found", *kinds).collect():
        b64 = tuple(r["_found"]) if r["_found"] else (None, None)
        u, w = ("lz-uri", r["_uri"]), ("lz-utf16", r["_utf16"])
        if options.older_routes:
            tries = [u, b64] if r["uri"] or r["shape"] else [w]
        else:
            tries = [b64, u, w] if r["like"] else [u, b64] if r["uri"] else [b64, u] if r["shape"] else [w]
        want = next((x for x in tries if reader.accepts(x[1])), None)
        assert got[r["token"], False] == want, r["token"]


def test_first_hits_across_batches(spark):
    """The first hit of every surface, however the stream of tokens is cut."""
    good, dull = "dXNlcj1hZG1pbiZyb2xlPW9w", "(((((((("
    more = "bm90ZT1oZWxsbyZpZD00Mg=="
    texts = [f"{'xyzzyxyzzy ' * i}{good} {more}" for i in range(9)] + ["", dull, more, "zzzzzzzzzz " * 7, f"{more} {good}", None, good]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "exchange_id long, ordinal int, text string").coalesce(1)
    want = {i: next((t for t in (good, more) if t and x and t == min((p for p in (good, more) if p in x), key=x.index, default=None)), None) for i, x in enumerate(texts)}
    want = {i: t for i, t in want.items() if t}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "2", "3", "5", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = decode.first_hits(rows, DecodeOptions(min_decoded=10)).collect()
            assert {r["exchange_id"]: r["token"] for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_memory_of_the_reader_is_bounded(monkeypatch):
    monkeypatch.setattr(routes, "REMEMBERED", 50)
    reader = routes.Reader(DecodeOptions())
    for i in range(30):
        reader.read([(f"token-number-{i}-{k}", False) for k in range(20)])
        assert len(reader.known) <= 50
    assert reader.read([("dXNlcj1hZG1pbiZyb2xlPW9w", False)] * 3) == {("dXNlcj1hZG1pbiZyb2xlPW9w", False): ("base64", "user=admin&role=op")}


def test_one_scan_and_no_shuffle_for_first_hits(spark):
    from wiresift import queries
    from wiresift.operators import surfaces

    hits = decode.first_hits(surfaces.decoding(queries.ex(spark, "/root/testdata/sf0.001")))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_the_cap_counts_characters():
    import base64

    reader = routes.Reader(DecodeOptions())
    words = ("words with an é now and then, " * 700)[:16_384]
    assert len(words.encode()) > codecs.CAP == len(words)
    for text, read in ((words, True), (words + "x", False)):
        token = base64.b64encode(codecs.compress(text.encode(), "gzip")).decode()
        assert (reader.read([(token, False)])[token, False] == ("gzip", text)) == read


def test_streams_that_end_amid_a_run_are_not_read(spark):
    """The bits behind an LZ-String's end are 0 in its run of the alphabet's characters, or it is none."""
    note = codecs.lz_encode("user=1&note=hello world", "uri")
    digests = ["pw=2a74d8cce1b8480f61d1c64287c824cac203529f", "pw=1abb4f0dc6af9cba11eced6cb63f1ada67dfefc8"]
    tokens = [*digests, note, f"{note}.next", f"{note}/view", f"{note}A$$"]
    options = DecodeOptions(min_decoded=4)
    want = [None, None, *["user=1&note=hello world"] * 4]

    def read(options):
        found = routes.Reader(options).read([(t, False) for t in tokens])
        return [found[t, False] and found[t, False][1] for t in tokens]

    assert read(options) == want
    assert read(replace(options, full_streams=False)) == ["99999", "9999999", *want[2:]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "token_id int, token string")
    found = [r["_uri"] for r in decode.with_routes(rows, options).orderBy("token_id").select("_uri").collect()]
    assert found == want
    ends = {}
    assert lzbatch.decode(tokens * 9, "uri", ends=ends) == [codecs.lz_decode(t, "uri") for t in tokens] * 9
    assert [ends[i] for i in range(9 * len(tokens))] == [codecs.lz_read(t, "uri")[1] for t in tokens] * 9


def test_padded_lz_string_is_read_by_the_base64_route(spark):
    """LZ-String pads with up to three = and leaves bits set that strict Base64 forbids."""
    notes = [f"user={i}&note=hello world" for i in range(1000, 1200)]
    tokens = [codecs.lz_encode(n) for n in notes]
    assert any(t.endswith("===") for t in tokens)
    read = routes.Reader(DecodeOptions()).read([(t, False) for t in tokens])
    assert [read[t, False] for t in tokens] == [("lz-base64", n) for n in notes]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "token_id int, token string")
    found = decode.first_accepted(F.array("_found"), DecodeOptions())
    rows = decode.with_routes(rows).orderBy("token_id").select(found.alias("f")).collect()
    assert [tuple(r["f"]) for r in rows] == [("lz-base64", n) for n in notes]
    words = ["password=", "password===="]
    assert not any(routes.Reader(DecodeOptions()).read([(w, False) for w in words]).values())


def test_raw_deflate_has_to_end_where_its_token_does(spark):
    """Digests whose bytes begin a raw deflate stream that breaks off are no reading; nor is one that goes on."""
    import base64

    note = b"user=1&note=hello world, hello world"
    packed = codecs.compress(note, "deflate")
    tokens = ["c0305ba27a9813a96f0fdd4ac1264156", "0210f6890d5d22544312834fd645dc47"]
    tokens += [base64.b64encode(b).decode() for b in (packed, packed[:-3], packed + b"more", codecs.compress(note, "zlib")[:-3])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "token_id int, token string")

    def read(options):
        found = routes.Reader(options).read([(t, False) for t in tokens])
        return [found[t, False] and found[t, False][0] for t in tokens]

    def columns(options):
        found = decode.first_accepted(F.array("_found"), options)["route"]
        return [r["f"] for r in decode.with_routes(rows, options).orderBy("token_id").select(found.alias("f")).collect()]

    for options, want in ((DecodeOptions(), [None, None, "deflate", None, None, "zlib"]), (DecodeOptions(full_streams=False), [*["deflate"] * 5, "zlib"])):
        assert read(options) == want and columns(options) == want
    every = decode.variants(rows).where("variant = 'Base64 deflate'").select("token_id").collect()
    assert [r[0] for r in every] == [2]


def test_lz_strings_that_end_amid_a_run_keep_no_route_from_a_token(spark):
    """Packed bytes whose first bits happen to be an LZ-String are unpacked all the same."""
    import base64

    texts = [f"page={i}&from=https://host{i % 7}.example.com/{i * i}&words=" + "some words, and more of them " * (i % 4) for i in range(300)]
    for codec in codecs.CODECS:
        tokens = [base64.b64encode(codecs.compress(t.encode(), codec)).decode() for t in texts]
        found = routes.Reader(DecodeOptions()).base64_readings(tokens)
        assert [found.get(t) for t in tokens] == [(codec, t) for t in texts]
        rows = spark.createDataFrame(list(enumerate(tokens[:40])), "token_id int, token string")
        columns = decode.with_routes(rows).orderBy("token_id").select("_found.*").collect()
        assert [tuple(r) for r in columns] == [(codec, t) for t in texts[:40]]
    token = base64.b64encode(codecs.compress(texts[1].encode(), "snappy")).decode()
    assert not routes.Reader(DecodeOptions(full_streams=False)).base64_readings([token])


def test_packed_bytes_that_look_like_text_are_unpacked(spark):
    """lz4 and brotli store what they can't pack, so their bytes pass the gate of text."""
    import base64

    rng = random.Random(5)
    text = "a:b, " + "".join(rng.choice(string.ascii_letters + string.digits + " .,;-+*") for _ in range(990))
    data = codecs.compress(text.encode(), "lz4")
    token, plain = (base64.b64encode(b).decode() for b in (data, text.encode() + b"\xff"))
    reader = routes.Reader(DecodeOptions())
    assert reader.passes(data.decode("utf-8", "replace"))
    want = {token: ("lz4", text), plain: ("base64", text + "\ufffd")}
    assert reader.base64_readings(want) == want
    rows = spark.createDataFrame([(t,) for t in want], "token string")
    assert {r["token"]: tuple(r["_found"]) for r in decode.with_routes(rows).collect()} == want


def pages_at(spark, path, *rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_the_base64_route_of_whole_pages(spark, tmp_path):
    """Every encoding of all of a page, url and html, whatever its length."""
    import hashlib

    from wiresift import queries

    rows = [(7, "https://host.example.com/" + "x" * 80, "<p>Some words, \n and an é</p>" * 900), (8, None, None), (9, "http://a.example", "")]
    got = {(r["token_id"], r["route"], r["decoded"]) for r in queries.QUERIES["t12_base64_route"](spark, pages_at(spark, tmp_path, *rows)).collect()}
    want = set()
    for page, url, html in rows:
        whole = f"{url or ''}\n{html or ''}"
        for i in range(0, len(whole), queries.PIECE):
            text = f"page={page}&piece={i // queries.PIECE}&text={whole[i : i + queries.PIECE]}"
            kinds = {"Base64": "base64", "Base64URL": "base64", "LZ-Base64": "lz-base64", "LZ-URI": "lz-uri"} | {f"{c}+Base64": c for c in codecs.CODECS}
            want |= {(f"{page}/{i // queries.PIECE}/{k}", r, hashlib.md5(text.encode()).hexdigest()) for k, r in kinds.items()}
    assert got == want and len(want) > 250


def test_the_cascade_takes_all_tokens_of_the_pages(spark, tmp_path):
    """Words of urls and html and the encodings of urls count, and the tokens that no route reads."""
    from wiresift import queries

    def counts(name, *rows):
        return {r["route"]: r["n"] for r in queries.QUERIES["t13_token_cascade"](spark, pages_at(spark, tmp_path / name, *rows)).collect()}

    url, token = "https://host.example.com/some/page", "dXNlcj1hZG1pbiZyb2xlPW9w"
    bare = counts("bare", (12, None, None))
    with_url = counts("url", (12, url, None))
    full = counts("html", (12, url, f"<p>{token}</p> <p>((unreadable.words.here))</p>"))
    # the planted text and the url in as many encodings; Base64 with and without padding
    assert {c: bare[c] for c in codecs.CODECS} == dict.fromkeys(codecs.CODECS, 1)
    assert {c: with_url[c] for c in codecs.CODECS} == dict.fromkeys(codecs.CODECS, 2) and with_url["base64"] > bare["base64"]
    assert full["base64"] == with_url["base64"] + 1 and full[None] > with_url[None]
