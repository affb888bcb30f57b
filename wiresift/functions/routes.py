"""The cascade over tokens in batches: which decode route reads a token first.

The same rules as the columns of operators.decode.with_routes(), for a stage that takes a
stream of tokens: each distinct token of a batch is read once, LZ-String side by side, and
what was read is remembered by the worker, up to a bound.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterable

from ..options import DecodeOptions
from . import codecs, lzbatch

#: Tokens, and characters in them and their readings, that a worker remembers.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64 << 20

_URI = re.compile(r"[^A-Za-z0-9+\-$_.]+")
_BASE64 = re.compile(r"[A-Za-z0-9_\-+/]*=*")
_SHAPE = re.compile(r"[A-Za-z0-9_\-+/=]*")
_PRINTABLE = bytes([*range(0x20, 0x7F), 9, 10, 13])
_ASCII = bytes(range(128))
_CONTROL = bytes([*range(9), 11, 12, *range(14, 32)])
_BLANK = "".join(map(chr, range(33)))
_FIELDS = re.compile(r"(?s)[^@]+@.*\.")

Reading = tuple[str, str]


def shares(text: str) -> tuple[float, float, float]:
    """Shares of printable, ASCII and control characters."""
    data, n = text.encode("utf-8", "surrogatepass"), len(text)
    return tuple((len(data) - len(data.translate(None, some))) / n for some in (_PRINTABLE, _ASCII, _CONTROL))


def malformed(data: bytes) -> bool:
    """Are the bytes no UTF-8?"""
    try:
        data.decode("utf-8")
        return False
    except UnicodeDecodeError:
        return True


def balanced(text: str) -> bool:
    """Never more than two closing braces ahead of the opening ones."""
    depth = 0
    for c in re.findall(r"[{}]", text):
        depth += 1 if c == "{" else -1
        if depth < -2:
            return False
    return True


def structured(text: str, brace_balance: bool) -> bool:
    t = text.strip(_BLANK)
    if len(t) > 1 and (t[0] == "{" and t[-1] == "}" or t[0] == "[" and t[-1] == "]") and (not brace_balance or balanced(t)):
        return True
    return t.startswith(("http://", "https://")) or (t.find(":") > 0 and t.find(",") > 0) or bool(_FIELDS.match(t))


class Reader:
    """Reads tokens by one set of options."""

    def __init__(self, options: DecodeOptions):
        self.o = options
        self.gate = (0.90, 0.85, 0.01, 0.94) if options.strict else (0.80, 0.70, 0.03, 0.86)
        self.known: dict[tuple[str, bool], Reading | None] = {}
        self.chars = 0

    def passes(self, text: str) -> bool:
        if not text:
            return False
        printable, plain, control = shares(text)
        p, a, c, high = self.gate
        return printable >= p and plain >= a and control <= c and (printable >= high or structured(text, self.o.brace_balance))

    def accepts(self, text: str | None) -> bool:
        if text is None or not self.o.min_decoded <= len(text) <= self.o.max_decoded or not self.passes(text):
            return False
        printable, _, control = shares(text)
        return not self.o.readable_only or (control <= 0.05 and printable >= 0.70)

    def looks_uri_safe(self, token: str) -> bool:
        n = len(token)
        return n >= max(1, self.o.min_token) and len(_URI.sub("", token)) / n >= (0.95 if self.o.strict else 0.85)

    def has_shape(self, token: str) -> bool:
        return len(token) >= self.o.min_base64 and bool(_SHAPE.fullmatch(token))

    def looks_base64(self, token: str) -> bool:
        return len(token) >= self.o.min_token and bool(_BASE64.fullmatch(token))

    def lz_padded(self, token: str) -> bool:
        """Padded as LZ-String pads: up to three =, and left-over bits that strict Base64 forbids."""
        return len(token) % 4 == 0 and token.endswith("=") and bool(_BASE64.fullmatch(token))

    def fills(self, text: str, alphabet: str, end: int) -> bool:
        return not self.o.full_streams or codecs.lz_fills(text, alphabet, end)

    def base64_bytes(self, token: str, normal: str) -> bytes | None:
        """Decoded bytes, where they encode to the same text again, or the padded text reads well."""
        try:
            data = base64.b64decode(normal, validate=True)
        except (binascii.Error, ValueError):
            return None
        if base64.b64encode(data).decode().rstrip("=") == normal.rstrip("="):
            return data
        return data if "=" in token and self.passes(data.decode("utf-8", "replace")) else None

    def packed(self, data: bytes) -> tuple[Reading | None, bool]:
        """The decompressors' first accepted result, and if any of them unpacks the data."""
        unpacked = False
        for codec in codecs.CODECS:
            out = codecs.decompress(data, codec, self.o.max_decoded + codecs.BEYOND, self.o.full_streams)
            unpacked = unpacked or out is not None
            if out is not None and self.accepts(text := out.decode("utf-8", "replace")):
                return (codec, text), True
        return None, unpacked

    def base64_route(self, token: str, normal: str, lz: str | None, end: int) -> Reading | None:
        """LZ-String first, if it fills its run, whatever its quality; then text; then the decompressors' first accepted result."""
        if lz and not self.fills(normal, "base64", end):
            lz = None
        if self.o.older_routes:
            return ("lz-base64", lz) if self.accepts(lz) else None
        data = self.base64_bytes(token, normal)
        if data is None and not self.lz_padded(token):
            return None
        if lz:
            return ("lz-base64", lz) if self.accepts(lz) else None
        if data is None:
            return None
        if self.passes(text := data.decode("utf-8", "replace")):
            # Stored pieces of packed bytes look like text: where they are malformed, what unpacks is none.
            reading, unpacked = self.packed(data) if self.o.full_streams and malformed(data) else (None, False)
            return reading if unpacked else ("base64", text) if self.accepts(text) else None
        return self.packed(data)[0]

    def _lz(self, found: dict, keys: list, alphabet: str) -> None:
        """Puts the accepted LZ-String readings of tokens that have none yet in `found`."""
        keys = [k for k in keys if k not in found]
        ends: dict[int, int] = {}
        texts = lzbatch.decode([k[0] for k in keys], alphabet, self.o.max_decoded, ends)
        for i, (k, t) in enumerate(zip(keys, texts)):
            if self.accepts(t := codecs.repaired(t)) and self.fills(k[0], alphabet, ends[i]):
                found[k] = (f"lz-{alphabet}", t)

    def _base64(self, found: dict, keys: list) -> None:
        keys = [k for k in keys if k not in found]
        normal, ends = [codecs.base64_normal(k[0]) for k in keys], {}
        for i, (k, lz) in enumerate(zip(keys, lzbatch.decode(normal, "base64", self.o.max_decoded, ends))):
            if reading := self.base64_route(k[0], normal[i], codecs.repaired(lz), ends.get(i, 0)):
                found[k] = reading

    def base64_readings(self, tokens: Iterable[str]) -> dict[str, Reading]:
        """What the Base64 route alone makes of tokens, for those that it reads."""
        found: dict[tuple[str, bool], Reading] = {}
        self._base64(found, [(t, False) for t in dict.fromkeys(tokens) if self.has_shape(t)])
        return {k[0]: r for k, r in found.items()}

    def uri_readings(self, tokens: Iterable[str]) -> dict[str, Reading]:
        """What the URI-safe route alone makes of tokens, for those that it reads."""
        found: dict[tuple[str, bool], Reading] = {}
        self._lz(found, [(t, False) for t in dict.fromkeys(tokens) if self.looks_uri_safe(t)], "uri")
        return {k[0]: r for k, r in found.items()}

    def _read(self, keys: list[tuple[str, bool]]) -> dict:
        """The first accepted reading of each (token, whole) that has one."""
        found: dict[tuple[str, bool], Reading] = {}
        uri = {k for k in keys if k[1] or self.looks_uri_safe(k[0])}
        shape = {k for k in keys if not k[1] and self.has_shape(k[0])}
        like = {k for k in keys if not k[1] and not self.o.older_routes and self.looks_base64(k[0])}
        late = [k for k in keys if not k[1] and k not in uri and k not in shape and k not in like]
        if self.o.older_routes:
            self._lz(found, [k for k in keys if k in uri], "uri")
            self._base64(found, [k for k in keys if k in shape])
        else:
            early = [k for k in keys if k in like or (k in shape and k not in uri)]  # Base64 before URI-safe
            self._base64(found, [k for k in early if k in shape])
            self._lz(found, [k for k in keys if k in uri], "uri")
            self._base64(found, [k for k in keys if k in shape and k in uri and k not in like])
            late += [k for k in keys if k in like]
        if self.o.try_utf16:
            self._lz(found, late, "utf16")
        return found

    def read(self, tokens: Iterable[tuple[str, bool]]) -> dict[tuple[str, bool], Reading | None]:
        """Readings of all (token, whole), none for those that no route reads."""
        wanted = dict.fromkeys(tokens)
        fresh = [k for k in wanted if k not in self.known]
        found = self._read(fresh)
        out = {k: self.known[k] if k in self.known else found.get(k) for k in wanted}
        self._remember(fresh, found)
        return out

    def _remember(self, fresh: list, found: dict) -> None:
        chars = sum(len(k[0]) + len(found[k][1] if k in found else "") for k in fresh)
        if len(self.known) + len(fresh) > REMEMBERED or self.chars + chars > REMEMBERED_CHARS:
            self.known, self.chars = {}, 0
            if len(fresh) > REMEMBERED or chars > REMEMBERED_CHARS:
                return
        self.known.update((k, found.get(k)) for k in fresh)
        self.chars += chars


_READERS: dict[DecodeOptions, Reader] = {}


def reader(options: DecodeOptions) -> Reader:
    """The worker's reader for these options, with what it remembers."""
    return _READERS.setdefault(options, Reader(options))
