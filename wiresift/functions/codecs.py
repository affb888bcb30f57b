"""Byte-level codecs and the Arrow functions that apply them to columns.

Only what Spark has no expression for: each helper handles one value, Spark
moves the rows.  Every decompressor stops once its output is over a cap.
"""

from __future__ import annotations

import base64
import gzip
import json
import quopri
import re
import zlib
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 16_384
#: Bytes beyond the cap that are still unpacked: a text may have more bytes than characters.
BEYOND = 8_192
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
URI_SAFE = BASE64[:-1] + "-$"


# --- LZ-String -------------------------------------------------------------


def _bit_texts(alphabet: str) -> dict[str, str]:
    return {c: format(i & 63, "06b") for i, c in enumerate(alphabet)}  # the 65th character, which pads, is 0


_BITS = {"base64": _bit_texts(BASE64), "uri": _bit_texts(URI_SAFE) | {" ": format(URI_SAFE.index("+"), "06b")}}


def lz_bits(text: str, alphabet: str) -> str:
    """A token's bits as a text of 0 and 1; `alphabet` is base64, uri or utf16.  Unknown characters are 0."""
    if alphabet == "utf16":
        return "".join([format(max(ord(c) - 32, 0) & 0x7FFF, "015b") for c in text])
    table = _BITS[alphabet]
    return "".join([table.get(c, "000000") for c in text])


def lz_decode(text: str | None, alphabet: str, cap: int = CAP) -> str | None:
    """Decoded text; empty for an empty stream; null for one that is malformed, truncated or over the cap."""
    return lz_read(text, alphabet, cap)[0]


def lz_read(text: str | None, alphabet: str, cap: int = CAP) -> tuple[str | None, int]:
    """Decoded text as lz_decode() gives it, and the bits that were read."""
    if not text:
        return None, 0
    bits, at = lz_bits(text, alphabet), 0

    def read(n: int) -> int:
        """The next n bits, the least significant first."""
        nonlocal at
        at += n
        if at > len(bits):
            raise EOFError
        return int(bits[at - n : at][::-1], 2)

    try:
        kind = read(2)
        if kind == 2:
            return "", at
        if kind == 3:
            return None, at
        phrase = chr(read(8 if kind == 0 else 16))
        known, out, size, n = {3: phrase}, [phrase], 3, len(phrase)
        nxt, left = 4, 4
        while True:
            code = read(size)
            if code == 2:
                return _whole("".join(out)), at
            if code in (0, 1):
                known[nxt] = chr(read(8 if code == 0 else 16))
                code, nxt, left = nxt, nxt + 1, left - 1
                if left == 0:
                    left, size = 1 << size, size + 1
            if code in known:
                entry = known[code]
            elif code == nxt:
                entry = phrase + phrase[0]
            else:
                return None, at
            out.append(entry)
            n += len(entry)
            if n > cap:
                return None, at
            known[nxt] = phrase + entry[0]
            nxt, left, phrase = nxt + 1, left - 1, entry
            if left == 0:
                left, size = 1 << size, size + 1
    except (EOFError, ValueError):
        return None, at


_RUNS = {"base64": re.compile(r"[A=]*(?![A-Za-z0-9+/])"), "uri": re.compile(r"[A$]*(?![A-Za-z0-9+\- ])")}


def lz_fills(text: str, alphabet: str, end: int) -> bool:
    """Does a stream that ends at this bit take up its run of the alphabet's characters, but for bits that are 0, as an encoder leaves them?

    UTF-16 has no alphabet that runs could be told by.
    """
    if alphabet == "utf16":
        return True
    at, part = divmod(end, 6)
    if part and "1" in lz_bits(text[at], alphabet)[part:]:
        return False
    return bool(_RUNS[alphabet].match(text, at + (part > 0)))


def _whole(text: str) -> str:
    """Text whose surrogate pairs are one character each; a lone half becomes a replacement character."""
    if any("\ud800" <= c <= "\udfff" for c in text):
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def lz_encode(text: str, alphabet: str = "base64") -> str:
    """The encoding that lz_decode reads; characters beyond 16 bits go as their surrogates."""
    width = 15 if alphabet == "utf16" else 6
    bits: list[str] = []

    def write(value: int, n: int) -> None:
        bits.append(format(value, f"0{n}b")[::-1])

    codes: dict[str, int] = {}  # of characters
    longer: dict[tuple[int, str], int] = {}  # of a phrase and the character behind it
    fresh: dict[int, str] = {}  # characters that were not written yet
    nxt, size, left = 3, 2, 2

    def grow() -> None:
        nonlocal left, size
        left -= 1
        if left == 0:
            left, size = 1 << size, size + 1

    def emit(phrase: int) -> None:
        if phrase in fresh:
            unit = ord(fresh.pop(phrase))
            wide = unit > 255
            write(1 if wide else 0, size)
            write(unit, 16 if wide else 8)
            grow()
        else:
            write(phrase, size)
        grow()

    phrase = 0
    for c in _units(text):
        own = codes.get(c)
        if own is None:
            own = codes[c] = nxt
            fresh[own], nxt = c, nxt + 1
        if not phrase:
            phrase = own
        elif (phrase, c) in longer:
            phrase = longer[phrase, c]
        else:
            emit(phrase)
            longer[phrase, c], nxt = nxt, nxt + 1
            phrase = own
    if phrase:
        emit(phrase)
    write(2, size)
    stream = "".join(bits)
    stream += "0" * (-len(stream) % width)
    out = [int(stream[i : i + width], 2) for i in range(0, len(stream), width)]
    if alphabet == "utf16":
        return "".join(chr(x + 32) for x in out) + " "
    table = BASE64 if alphabet == "base64" else URI_SAFE
    encoded = "".join(table[x] for x in out)
    return encoded + "=" * (-len(encoded) % 4) if alphabet == "base64" else encoded


def _units(text: str) -> str:
    """Text with characters beyond 16 bits as surrogate pairs, which _whole() joins."""
    if not text or max(text) <= "\uffff":
        return text
    data = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(data[i] | data[i + 1] << 8) for i in range(0, len(data), 2))


# --- compression -----------------------------------------------------------


GZIP = b"\x1f\x8b\x08"


def _gunzip(data: bytes, cap: int) -> bytes | None:
    """All members; what follows the last one is ignored."""
    out = b""
    try:
        while data.startswith(GZIP):
            reader = zlib.decompressobj(31)
            out += reader.decompress(data, cap + 1 - len(out))
            if not reader.eof or len(out) > cap:
                return None
            data = reader.unused_data
    except zlib.error:
        return None
    return out


def _zlib(data: bytes, window: int, cap: int, full: bool = False) -> bytes | None:
    """Unpacked bytes; those of a stream that breaks off too, or that something follows, unless `full`."""
    try:
        reader = zlib.decompressobj(window)
        out = reader.decompress(data, cap + 1)
    except zlib.error:
        return None
    whole = reader.eof and not (full and reader.unused_data)
    return out if len(out) <= cap and (whole or (out and not full)) else None


def _arrow(data: bytes, codec: str, cap: int) -> bytes | None:
    try:
        out = pa.CompressedInputStream(pa.BufferReader(data), codec).read(cap + 1)
        return out if out and len(out) <= cap else None
    except (pa.ArrowException, OSError, ValueError):
        return None


def _unpacks(data: bytes, cap: int) -> bool:
    """Does brotli data begin with a whole stream of at most so many bytes?"""
    try:
        pa.Codec("brotli").decompress(data, cap)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def _brotli(data: bytes, cap: int) -> bytes | None:
    """All streams.  PyArrow's stream reader never frees some 10 KB once it meets an error, so it is given whole streams alone."""
    out = b""
    while data:
        if not _unpacks(data, max(1, cap - len(out))):
            return None
        low, end = 0, len(data)
        if _unpacks(data[:-1], cap):  # something follows the stream: the shortest start that unpacks is the stream
            while end - low > 1:
                mid = (low + end) // 2
                low, end = (low, mid) if _unpacks(data[:mid], cap) else (mid, end)
        out += _arrow(data[:end], "brotli", cap) or b""
        data = data[end:]
    return out if out and len(out) <= cap else None


_SNAPPY = b"\x82SNAPPY\x00"


def _snappy_frames(data: bytes, cap: int) -> bytes | None:
    """The stream format with a 16-byte header and length-prefixed blocks."""
    if not data.startswith(_SNAPPY) or len(data) < 16:
        return None
    at, out = 16, b""
    try:
        while at + 4 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            block = data[at + 4 : at + 4 + n]
            size, shift = 0, 0
            for b in block:  # the block's own length prefix
                size |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            if len(block) != n or len(out) + size > cap:
                return None
            out += pa.Codec("snappy").decompress(block, size).to_pybytes()
            at += 4 + n
        return out
    except (pa.ArrowException, OSError, ValueError):
        return None


DECOMPRESSORS = {
    "gzip": _gunzip,
    "zlib": lambda b, cap: _zlib(b, 15, cap),
    "deflate": lambda b, cap: _zlib(b, -15, cap),
    "brotli": _brotli,
    "lz4": lambda b, cap: _arrow(b, "lz4", cap),
    "zstd": lambda b, cap: _arrow(b, "zstd", cap),
    "snappy": _snappy_frames,
}


def may_be(data: bytes, codec: str) -> bool:
    """Could the data be of this codec, by its first bytes?"""
    start = data[:4]
    if codec == "gzip":
        return start[:3] == GZIP
    if codec == "zlib":
        return len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0
    if codec in ("lz4", "zstd"):  # a frame, or one that is skipped
        return start == (b"\x04\x22\x4d\x18" if codec == "lz4" else b"\x28\xb5\x2f\xfd") or (start[1:] == b"\x2a\x4d\x18" and 0x50 <= start[0] < 0x60)
    return True


def decompress(data: bytes | None, codec: str, cap: int = CAP, full: bool = False) -> bytes | None:
    """Unpacked bytes, if the data are of this codec.

    Raw deflate has no mark that tells it from other bytes: with `full` it has to end where the data do.
    """
    if data is None or not may_be(data, codec):
        return None
    return _zlib(data, -15, cap, True) if full and codec == "deflate" else DECOMPRESSORS[codec](data, cap)


def compress(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    if codec in ("zlib", "deflate"):
        packer = zlib.compressobj(wbits=15 if codec == "zlib" else -15)
        return packer.compress(data) + packer.flush()
    if codec == "snappy":
        block = pa.Codec("snappy").compress(data).to_pybytes()
        return _SNAPPY + (1).to_bytes(4, "big") * 2 + len(block).to_bytes(4, "big") + block
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, codec) as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


#: Unpacked at once, looked at once, and searched for a place to cut.
PIECE, SEGMENT, SEAM = 1 << 18, 1 << 20, 1 << 16
_CUT = re.compile(rb"[^\s:=]\s+(?=[^\s:=])")


def _pieces(data: bytes, codec: str):
    """Unpacked bytes, piece by piece; an error where the data breaks off."""
    if codec == "brotli":
        reader = pa.CompressedInputStream(pa.BufferReader(data), codec)
        while out := reader.read(PIECE):
            yield out
        return
    window = {"gzip": 31, "zlib": 15, "deflate": -15}[codec]
    while data:
        reader, fed = zlib.decompressobj(window), data
        while not reader.eof:
            out = reader.decompress(fed, PIECE)
            fed = reader.unconsumed_tail
            if out:
                yield out
            elif not reader.eof and not fed:
                raise EOFError
        data = reader.unused_data if codec == "gzip" and reader.unused_data.startswith(GZIP) else b""


def inflate(body: bytes | None, encoding: str | None, cap: int, least: int = 8) -> list[bytes] | None:
    """A body less its content encoding; the body itself where that fails or none is known.

    What unpacks to more than `cap` bytes comes in segments, and only those in which a digest can
    stand, with a run of `least` hex digits or a `$`: whatever the size, what is held is one
    segment and those.  Segments are cut at blanks that part words, if there are any in SEAM bytes.
    """
    if body is None:
        return None
    kind = (encoding or "").strip().lower()
    tries = {"gzip": ["gzip"], "x-gzip": ["gzip"], "deflate": ["zlib", "deflate"], "br": ["brotli"]}.get(kind, [])
    for codec in tries:
        try:
            if body:
                return _segments(_pieces(body, codec), cap, re.compile(rb"[0-9A-Fa-f]{%d}|\$" % max(1, least)))
        except (zlib.error, pa.ArrowException, OSError, ValueError, EOFError):
            continue
    return [body]


def _segments(pieces, cap: int, likely: re.Pattern) -> list[bytes]:
    held, kept, over = bytearray(), [], False
    for piece in pieces:
        held += piece
        over = over or len(held) > cap
        while over and len(held) > SEGMENT:
            cut = max((m.end() for m in _CUT.finditer(held, SEGMENT - SEAM, SEGMENT)), default=SEGMENT)
            if likely.search(held, 0, cut):
                kept.append(bytes(held[:cut]))
            del held[:cut]
    if not over or likely.search(held):
        kept.append(bytes(held))
    return kept


def base64_normal(text: str) -> str:
    """The plain alphabet, padded to a multiple of four."""
    plain = text.translate({45: "+", 95: "/"})
    return plain + "=" * (-len(plain) % 4)


# --- text encodings --------------------------------------------------------


def base32_bytes(text: str | None) -> bytes | None:
    """Without padding, in any case; left-over bits are ignored; null for other characters."""
    value, bits, out = 0, 0, bytearray()
    for c in (text or "").rstrip("=").upper():
        i = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567".find(c)
        if i < 0:
            return None
        value, bits = value << 5 | i, bits + 5
        if bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    return bytes(out) if text else None


def base32_text(data: bytes) -> str:
    return base64.b32encode(data).decode().rstrip("=")


_HEX = set("0123456789abcdefABCDEF")


def quoted_printable_bytes(text: str | None) -> bytes | None:
    """`=HH` is a byte; malformed escapes stay; other characters keep their low byte."""
    if text is None:
        return None
    out, i = bytearray(), 0
    while i < len(text):
        if text[i] == "=" and set(text[i + 1 : i + 3]) <= _HEX and i + 2 < len(text):
            out.append(int(text[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(ord(text[i]) & 255)
            i += 1
    return bytes(out)


def quoted_printable_text(data: bytes) -> str:
    return quopri.encodestring(data, quotetabs=True).decode("ascii").replace("=\n", "")


def repaired(text: str | None) -> str | None:
    """Text with replacement characters, read again as UTF-8 from its Latin-1 bytes."""
    if text is None or "�" not in text:
        return text
    return text.encode("latin-1", "replace").decode("utf-8", "replace")


def repaired_text(text: Column) -> Column:
    """repaired() of a column, as an expression."""
    single = F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    return F.when(F.contains(text, F.lit("\ufffd")), F.make_valid_utf8(single.cast("string"))).otherwise(text)


def json_values(body: str | None, origin: str = "") -> list[tuple[str, str, str]]:
    """(path, key, string) of the strings that stand under a key of a JSON object or list, depth first."""
    try:
        stack = [(origin, None, json.loads(body))] if body else []
    except (ValueError, RecursionError):
        return []
    out = []
    while stack:
        at, key, node = stack.pop()
        if isinstance(node, dict):
            stack += [(f"{at}:key:{k}", k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(f"{at}:idx:{i}", None, v) for i, v in reversed(list(enumerate(node)))]
        elif isinstance(node, str) and key is not None:
            out.append((at, key, node))
    return out


def leaf(value: tuple[str, str, str]) -> dict:
    return {"location": value[0], "text": f"{value[1]}={value[2]}"}


def json_leaves(body: str | None, origin: str) -> list[dict]:
    """Strings of json_values() as `key=value` with their path."""
    return [leaf(v) for v in json_values(body, origin)]


def xml_values(body: str | None) -> list[tuple[str, str, str]]:
    """(xml, element, its own text) and (xml-attr, attribute, value) of an XML body; none where it is malformed or declares entities."""
    out, stack = [], []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name, attributes):
        out.extend(("xml-attr", k, v) for k, v in attributes.items() if v)
        stack.append((name, []))

    def end(_):
        name, texts = stack.pop()
        if text := "".join(texts).strip():
            out.append(("xml", name, text))

    def entity(*_):
        raise ValueError("an entity")

    parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, entity
    parser.CharacterDataHandler = lambda text: stack[-1][1].append(text)
    try:
        parser.Parse(body or "", True)
    except (expat.ExpatError, ValueError):
        return []
    return out


def body_values(json_body: str | None, xml_body: str | None) -> list[tuple[str, str, str]]:
    """(ptype, name, value) of the parameters that a JSON or XML body holds."""
    return [("json", k, v) for _, k, v in json_values(json_body) if v] + (xml_values(xml_body) if xml_body else [])


# --- columns ---------------------------------------------------------------

CODECS = ("gzip", "zlib", "deflate", "brotli", "lz4", "zstd", "snappy")


#: Bytes of an Arrow batch that are worked on at once, as their values stand in memory several times.
SLICE = 2 << 20


def in_slices(rows: DataFrame, f, kind: str) -> DataFrame:
    """f of slices of `rows`' Arrow batches, which are as large as their number of rows makes them; f yields batches of `kind`."""

    def run(batches):
        for b in batches:
            step = max(1, b.num_rows * SLICE // max(1, b.nbytes))
            for i in range(0, b.num_rows, step):
                yield from f(b.slice(i, step))

    return rows.mapInArrow(run, kind)


LEAVES = "array<struct<location:string,text:string>>"


PARAMETERS = "array<struct<ptype:string,name:string,value:string>>"


def parts_udf(cap: int, least: int = 8):
    """Packed bodies unpacked, JSON leaves of both sides, and the request's JSON and XML parameters, in one visit to Python.

    Takes the packed response body, its encoding, whether JSON in it counts, the response's JSON where
    it is not packed, and the request's JSON and XML; null where there is nothing to do.
    """

    def run(packed: pd.Series, encoding: pd.Series, unpack_json: pd.Series, answer: pd.Series, request: pd.Series, xml: pd.Series) -> pd.DataFrame:
        bodies = [inflate(b, e, cap, least) for b, e in zip(packed, encoding)]
        answers = [b[0].decode("utf-8", "replace") if j and b is not None and len(b) == 1 else a for b, j, a in zip(bodies, unpack_json, answer)]
        columns = {
            "bodies": bodies,
            "request": [json_leaves(r, "request-body-json") for r in request],
            "response": [json_leaves(a, "response-body-json") for a in answers],
            "params": [parameters(r, x) for r, x in zip(request, xml)],
        }
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})

    kind = f"struct<bodies:array<binary>,request:{LEAVES},response:{LEAVES},params:{PARAMETERS}>"
    return F.pandas_udf(run, kind).asNondeterministic()


def parameters(json_body: str | None, xml_body: str | None) -> list[dict]:
    return [dict(zip(("ptype", "name", "value"), v)) for v in body_values(json_body, xml_body)]


def parameters_udf():
    """The request's JSON and XML parameters alone."""

    def run(request: pd.Series, xml: pd.Series) -> pd.Series:
        return pd.Series([parameters(r, x) for r, x in zip(request, xml)], dtype=object)

    return F.pandas_udf(run, PARAMETERS)


def lz_decode_udf(alphabet: str, cap: int = CAP):
    def run(text: pd.Series) -> pd.Series:
        from . import lzbatch

        return pd.Series([repaired(t) for t in lzbatch.decode(list(text), alphabet, cap)], dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()  # no filter is worked out twice below it


def lz_read_udf(alphabet: str, cap: int = CAP):
    """What lz_decode_udf() gives, and if the stream fills its run."""

    def run(text: pd.Series) -> pd.DataFrame:
        from . import lzbatch

        ends: dict[int, int] = {}
        found = [repaired(t) for t in lzbatch.decode(list(text), alphabet, cap, ends)]
        fills = [bool(t) and lz_fills(text.iloc[i], alphabet, ends[i]) for i, t in enumerate(found)]
        return pd.DataFrame({"text": pd.Series(found, dtype=object), "fills": fills})

    return F.pandas_udf(run, "struct<text:string,fills:boolean>").asNondeterministic()


def decompress_udf(codec: str, cap: int = CAP, full: bool = False):
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([decompress(b, codec, cap, full) for b in data], dtype=object)

    return F.pandas_udf(run, "binary").asNondeterministic()


def bytes_udf(f):
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in text], dtype=object)

    return F.pandas_udf(run, "binary").asNondeterministic()


def encode_udf(codec: str):
    """Text to the bytes of a compressed or LZ-String form, as text."""

    def run(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            data = t.encode()
            if codec.startswith("lz-"):
                return lz_encode(t, codec[3:])
            if codec == "base32":
                return base32_text(data)
            if codec == "quoted-printable":
                return quoted_printable_text(data)
            return base64.b64encode(compress(data, codec)).decode()

        return pd.Series([one(t) for t in text], dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()  # no filter is worked out twice below it
