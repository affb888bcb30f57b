"""Token ids from a tokenizers file, with a bounded memory of words already met.

Byte-level BPE with the usual splitting pattern starts a new piece at every
white-space character that follows another character, and at every full stop
or comma that follows a letter or digit.  So a text without two white-space
characters in a row can be cut there, and each distinct piece need only be
encoded once.  Other texts go to the library whole.  Either way the ids are
the library's own.
"""

from __future__ import annotations

import json
import re
from array import array

from tokenizers import Tokenizer

#: Pieces remembered in a worker; at about 200 bytes each, 200 MB.  Then it starts afresh.
REMEMBERED = 1_000_000

_PAIR = re.compile(r"\s\s|\x00")
_LONE = re.compile(r"[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,]")
_loaded: dict[str, "Encoder"] = {}


class Pieces(dict):
    """Ids of pieces, encoded when first met."""

    def __init__(self, encode):
        super().__init__({"": b""})
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids = self.encode(piece)
        return ids


class Encoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        #: cutting at white space is known to be exact for this set-up alone
        self.cuts = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", False)
        )
        #: a text that spells a special token goes to the library whole
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.known = Pieces(self.whole)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null is an empty text."""
        if not text:
            return b""
        if not self.cuts or _PAIR.search(text) or any(map(text.__contains__, self.special)):
            return self.whole(text)
        marked = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")
        if not _LONE.search(text):
            marked = marked.replace(".", "\x00.").replace(",", "\x00,")
        return b"".join(map(self.known.__getitem__, marked.split("\x00")))


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
