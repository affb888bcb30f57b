"""LZ-String streams decoded side by side.

All tokens of a batch take one code each in a step.  A phrase is a number: its parent
phrase, its last and its first character, its length.  Texts are put together at the end,
from the last character of every phrase backwards, again in steps over all phrases at
once.  A few tokens that go on long after the others are left to the plain decoder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from . import codecs

#: Characters in work at once, and tokens below which steps over all don't pay.
CHUNK, FEW = 1 << 20, 24


#: Bytes with their bits turned round.
_TURNED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


def _table(alphabet: str) -> np.ndarray:
    """Each character's six bits, turned round; 0 for others."""
    out = np.zeros(129, np.uint8)
    out[[ord(c) for c in alphabet]] = _TURNED[np.arange(len(alphabet)) & 63] >> 2
    return out


_TABLES = {"base64": _table(codecs.BASE64), "uri": _table(codecs.URI_SAFE)}
_TABLES["uri"][ord(" ")] = _TABLES["uri"][ord("+")]
_WIDTH = {"base64": 6, "uri": 6, "utf16": 15}


def decode(texts: Sequence[str | None], alphabet: str, cap: int = codecs.CAP, ends: dict[int, int] | None = None) -> list[str | None]:
    """What codecs.lz_decode() makes of each text; `ends` takes the bits that were read, by place, of those that have a text."""
    ends = {} if ends is None else ends
    out: list[str | None] = [None] * len(texts)
    room = 2 * cap + 8  # no text within the cap has more phrases
    most = 34 * (cap + 2) // _WIDTH[alphabet] + 2  # nor a code or a character of more than 17 and 16 bits
    texts = [t if not t or len(t) <= most else t[:most] for t in texts]
    some, chars = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        some.append(i)
        chars += len(t)
        if chars >= CHUNK:
            _decode(texts, some, alphabet, cap, room, out, ends)
            some, chars = [], 0
    if some:
        _decode(texts, some, alphabet, cap, room, out, ends)
    return out


class _Bits:
    """Numbers read from all texts' bits at any place, the least significant bit first."""

    def __init__(self, text: str, alphabet: str):
        self.width = _WIDTH[alphabet]
        chars = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if alphabet == "utf16":
            values = np.where(chars > 32, chars, 32).astype(np.uint32) - 32 & 0x7FFF
            turned = _TURNED[values & 255].astype(np.uint64) << np.uint64(7) | (_TURNED[values >> 8] >> 1).astype(np.uint64)
        else:
            turned = _TABLES[alphabet][np.minimum(chars, 128)].astype(np.uint64)
        # A character's bits and those of the next three (two, where they are wide), turned round.
        self.words = turned.copy()
        for k in range(1, 4 if self.width == 6 else 3):
            self.words[:-k] |= turned[k:] << np.uint64(k * self.width)

    def at(self, pos: np.ndarray, mask: np.ndarray | int) -> np.ndarray:
        place, off = np.divmod(pos, self.width)
        return (self.words.take(place, mode="clip") >> off.astype(np.uint64)).astype(np.int32) & mask


def _decode(texts, some: list[int], alphabet: str, cap: int, room: int, out: list, ends: dict[int, int]) -> None:
    bits = _Bits("".join([texts[i] for i in some]), alphabet)
    sizes = np.array([len(texts[i]) for i in some], np.int32) * _WIDTH[alphabet]
    end = np.cumsum(sizes, dtype=np.int32)
    begin = pos = end - sizes
    kind = bits.at(pos, 3)
    pos = pos + 2
    for k in np.flatnonzero((kind == 2) & (pos <= end)):
        out[some[k]] = ""
    wide = np.where(kind == 0, 8, 16).astype(np.int32)
    row = np.flatnonzero((kind < 2) & (pos + wide <= end)).astype(np.int32)
    # Every phrase costs two bits at least.
    rooms = np.minimum(sizes[row] // 2 + 8, room + 8)
    base = np.cumsum(rooms, dtype=np.int64)
    n = int(base[-1]) if len(base) else 0
    base = base - rooms
    parent = np.full(n, -1, np.int32)
    last, first = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    length = np.ones(n, np.int32)

    pos, end, wide = pos[row], end[row], wide[row]
    last[base + 3] = first[base + 3] = bits.at(pos, (1 << wide) - 1)
    pos = pos + wide
    prev, nxt, left, size, total = (np.full(len(row), x, np.int32) for x in (3, 4, 4, 3, 1))
    said_row, said_phrase = [row], [base + 3]
    done: list[np.ndarray] = []

    while len(row):
        if len(row) < FEW and len(said_row) > 256:
            for k in row:
                out[some[k]], ends[some[k]] = codecs.lz_read(texts[some[k]], alphabet, cap)
            break
        code = bits.at(pos, (1 << size) - 1)
        pos = pos + size
        # Most tokens end here: their bits are out, or they name a phrase that isn't there.
        good = (pos <= end) & (code <= nxt)
        over = good & (code == 2)
        if over.any():
            done.append(row[over])
            ends.update((some[k], e) for k, e in zip(row[over].tolist(), (pos[over] - begin[row[over]]).tolist()))
            good &= ~over
        if not good.all():
            row, pos, end, base, code, prev, nxt, left, size, total = (a[good] for a in (row, pos, end, base, code, prev, nxt, left, size, total))
        at = np.flatnonzero(code < 2)
        if len(at):
            wide = np.where(code[at] == 0, 8, 16).astype(np.int32)
            symbol = bits.at(pos[at], (1 << wide) - 1)
            pos[at] += wide
            place = base[at] + nxt[at]
            last[place] = first[place] = symbol
            code[at] = nxt[at]
            nxt[at] += 1
            left[at] -= 1
            grown = at[left[at] == 0]
            left[grown] = 1 << size[grown]
            size[grown] += 1
        # The phrase before and the first character of this one are a new phrase, which this one may be.
        place, before, entry = base + nxt, base + prev, base + code
        start = first[before]
        parent[place], last[place], first[place], length[place] = before, np.where(code == nxt, start, first[entry]), start, length[before] + 1
        total = total + length[entry]
        said_row.append(row)
        said_phrase.append(entry)
        prev, nxt, left = code, nxt + 1, left - 1
        grown = np.flatnonzero(left == 0)
        left[grown] = 1 << size[grown]
        size[grown] += 1
        keep = (total <= cap) & (pos <= end)
        if not keep.all():
            row, pos, end, base, prev, nxt, left, size, total = (a[keep] for a in (row, pos, end, base, prev, nxt, left, size, total))
    if done:
        _put_together(np.concatenate(done), said_row, said_phrase, parent, last, length, some, out)


def _put_together(done, said_row, said_phrase, parent, last, length, some, out) -> None:
    """Texts of the tokens that came to their end."""
    rows, phrases = np.concatenate(said_row), np.concatenate(said_phrase)
    wanted = np.zeros(len(some), bool)
    wanted[done] = True
    keep = wanted[rows]
    rows, phrases = rows[keep], phrases[keep]
    order = np.argsort(rows, kind="stable")  # the steps are in order already
    rows, phrases = rows[order], phrases[order]
    sizes = length[phrases].astype(np.int64)
    stop = np.cumsum(sizes)
    text = np.zeros(int(stop[-1]), "<u2")
    at, phrase = stop - 1, phrases.astype(np.int64)
    while len(at):
        text[at] = last[phrase]
        phrase = parent[phrase].astype(np.int64)
        more = phrase >= 0
        at, phrase = at[more] - 1, phrase[more]
    ends = np.searchsorted(rows, done, side="right") - 1
    starts = np.searchsorted(rows, done, side="left")
    lows, highs = (stop - sizes)[starts], stop[ends]
    pairs = bool(((text & 0xF800) == 0xD800).any())  # halves of characters: each text is put together by itself
    flat = "" if pairs else text.tobytes().decode("utf-16-le")
    for k, a, b in zip(done.tolist(), lows.tolist(), highs.tolist()):
        out[some[k]] = text[a:b].tobytes().decode("utf-16-le", "replace") if pairs else flat[a:b]
