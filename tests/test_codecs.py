import gzip
import os
import random
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from wiresift.functions import codecs

TEXT = st.text(st.characters(codec="utf-8", exclude_categories=("Cs",), max_codepoint=0xFFFF), max_size=60)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_lz_round_trip(text):
    for alphabet in ("base64", "uri", "utf16"):
        assert codecs.lz_decode(codecs.lz_encode(text, alphabet), alphabet) == text


@settings(max_examples=40, deadline=None)
@given(TEXT)
def test_byte_codecs_round_trip(text):
    data = text.encode()
    for name in codecs.CODECS:
        if data:
            assert codecs.decompress(codecs.compress(data, name), name) == data
    if data:
        assert codecs.base32_bytes(codecs.base32_text(data)) == data
    assert codecs.quoted_printable_bytes(codecs.quoted_printable_text(data)) == data


def test_known_stream():
    assert codecs.lz_decode("BYUwNmD2A0AECWsCGBbZtDUzkA==", "base64") == "hello, i am a 猫"
    assert codecs.lz_encode("hello, i am a 猫") == "BYUwNmD2A0AECWsCGBbZtDUzkA=="


def test_characters_beyond_16_bits():
    for alphabet in ("base64", "uri", "utf16"):
        for text in ("a\U0001f600b\U0001f600\U0001f600", "\U0001f600"):
            assert codecs.lz_decode(codecs.lz_encode(text, alphabet), alphabet) == text


def test_truncated_and_malformed_streams_give_nothing():
    assert codecs.lz_decode("BYUwNmD2", "base64") is None
    assert codecs.lz_decode(None, "uri") is None
    for name in codecs.CODECS:
        assert codecs.decompress(b"not packed", name) is None
        assert codecs.decompress(b"", name) is None


def test_output_is_capped():
    bomb = gzip.compress(b"a" * 1_000_000)
    assert codecs.decompress(bomb, "gzip", 1000) is None
    assert [len(b) for b in codecs.inflate(bomb, "GZIP", 2_000_000)] == [1_000_000]
    assert codecs.inflate(gzip.compress(b"no digest " * 200_000), "gzip", 1000) == []
    assert codecs.inflate(b"plain", "gzip", 1000) == [b"plain"] and codecs.inflate(b"x", None, 1000) == [b"x"]
    assert codecs.inflate(bomb[:-9], "gzip", 1000) == [bomb[:-9]] and codecs.inflate(b"", "gzip", 1000) == [b""]


def test_members_and_broken_streams():
    two = gzip.compress(b"first ") + gzip.compress(b"second")
    assert codecs.decompress(two, "gzip") == b"first second"
    assert codecs.decompress(two + b"what follows", "gzip") == b"first second"
    assert codecs.decompress(two[:-3], "gzip") is None
    assert codecs.inflate(two + b"\0\0", "gzip", 1000) == [b"first second"]
    for codec in ("zlib", "deflate"):  # what comes before the break counts
        whole = codecs.compress(b"some words that repeat, some words that end", codec)
        assert b"some words that repeat".startswith(codecs.decompress(whole[:15], codec)[:9])
        assert codecs.decompress(b"", codec) is None


def test_segments_of_large_bodies_lose_no_digest():
    import hashlib
    import re

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(30)]
    parts = [b"sha256:  " + d.encode() + b"\n" + b"plain words, nothing else \n" * 40_000 for d in digests]
    body = b"".join(parts)
    for kind, packed in (("gzip", gzip.compress(body)), ("deflate", codecs.compress(body, "zlib")), ("deflate", codecs.compress(body, "deflate")), ("br", codecs.compress(body, "brotli"))):
        got = codecs.inflate(packed, kind, 20_000_000)
        assert sum(map(len, got)) < len(body) and max(map(len, got)) <= codecs.SEGMENT
        assert [m.decode() for b in got for m in re.findall(rb"sha256:\s*([0-9a-f]+)", b)] == digests


def test_json_leaves():
    body = '{"a":"x","b":[1,"y",{"c":"z","d":null}],"e":{"f":"w"}}'
    assert codecs.json_leaves(body, "o") == [
        {"location": "o:key:a", "text": "a=x"},
        {"location": "o:key:b:idx:2:key:c", "text": "c=z"},
        {"location": "o:key:e:key:f", "text": "f=w"},
    ]
    assert codecs.json_leaves("not json", "o") == [] and codecs.json_leaves(None, "o") == []


def test_repair():
    assert codecs.repaired("cafÃ© �").startswith("café")
    assert codecs.repaired("plain") == "plain"


def test_xml_values():
    body = '<?xml version="1.0" encoding="ISO-8859-1"?><a x="1" y=""><b>t&amp;u</b><c> <d z="é"/>in<e>deep</e>side </c></a>'
    want = [("xml-attr", "x", "1"), ("xml", "b", "t&u"), ("xml-attr", "z", "é"), ("xml", "e", "deep"), ("xml", "c", "inside")]
    assert codecs.xml_values(body) == want
    for bad in (None, "", "no xml", "<a>", "<a></b>", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"):
        assert codecs.xml_values(bad) == []


def test_text_codecs_of_the_standard_library():
    """Encodings that are not our own."""
    import base64
    import quopri
    import random

    rng = random.Random(2)
    for n in range(1, 60):
        data = rng.randbytes(n)
        assert codecs.base32_bytes(base64.b32encode(data).decode()) == data
        assert codecs.base32_bytes(base64.b32encode(data).decode().rstrip("=").lower()) == data
        line = bytes(b for b in data if b not in b"\r\n")
        assert codecs.quoted_printable_bytes(quopri.encodestring(line).decode("latin-1").replace("=\n", "")) == line


def test_brotli_streams_leave_nothing_behind():
    """Failed streams keep no memory; what follows a stream must be one too; the cap counts all of them."""
    rng, one = random.Random(1), codecs.compress(b"hello " * 9, "brotli")
    junk = [rng.randbytes(60) for _ in range(2_000)] + [one[:-2], one + b"junk"] * 500
    for b in junk:
        codecs.decompress(b, "brotli")
    before = resident_mb()
    for _ in range(5):
        assert all(codecs.decompress(b, "brotli") is None for b in junk[-1_000:])
        for b in junk:
            codecs.decompress(b, "brotli")
    assert resident_mb() - before < 50
    assert codecs.decompress(one + one, "brotli") == b"hello " * 18
    assert [codecs.decompress(codecs.compress(b"a" * n, "brotli") + one, "brotli", 100) is None for n in (46, 47)] == [False, True]


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
