"""Line de-duplication by a deletion-neighbourhood join.

Two lines are near copies if one word inserted, deleted or replaced turns one
into the other.  A line's variants are itself and itself less any one word.
Lines of equal length at distance one agree after both lose the word at the
same place; lines whose lengths differ by one agree when the longer loses a
word.  So the hashed key of a variant, with the place of the word it lost,
meets exactly the lines within the bound: that the places agree is the check
of the edit distance, and a second hash of the same words confirms the key.  A line goes if an earlier line (by doc_id, then line
number) is within the bound; the earliest stays.

Before variants are made, each line lists its halves: of two lines within the
bound one half is whole.  Lines that share no half with another line have no
near copy and list no variant, and where only one half is shared the lost word
lies in the other.

Words are split at white space and compared with A-Z lower-cased.  Lines of
fewer than MIN_WORDS words have no near copies, since one word is much of
them: with `short` they go where an earlier line has the same words, otherwise
they stay.  Null texts stay as they are; rows with a null
doc_id have no place in the order and stay whole.  Rows with an equal doc_id
are one after another in no order: their lines do not remove each other.
"""

from __future__ import annotations

from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .kernel import LINED, SPACED, U64, buffers, mix, powers, runs, segments, signed, spans, text_mark, text_marks, words

MIN_WORDS = 8


class Lines(NamedTuple):
    """Lines in several texts."""

    text: np.ndarray
    number: np.ndarray  # of the line in its text, counting all
    start: np.ndarray  # first word
    end: np.ndarray
    name: np.ndarray  # of all words
    mark: np.ndarray  # of each text

    def where(self, own: np.ndarray) -> Lines:
        return self._replace(text=self.text[own], number=self.number[own], start=self.start[own], end=self.end[own])


def lines(raw: np.ndarray, cut: np.ndarray, least: int = MIN_WORDS) -> Lines:
    """The lines of `least` words or more."""
    w = words(raw, cut, SPACED)
    first, last = segments(raw, cut, LINED)  # empty lines have no words and are not found
    start, end = np.searchsorted(w.start, first), np.searchsorted(w.start, last)
    long = np.flatnonzero(end - start >= least)
    text = np.searchsorted(cut, first[long], "right") - 1
    breaks = np.flatnonzero(raw == 10)
    number = np.searchsorted(breaks, first[long]) - np.searchsorted(breaks, cut[text])
    return Lines(text, number, start[long], end[long], w.name, text_marks(raw, cut))


def _halves(x: Lines) -> np.ndarray:
    """(lines, 4): first and second half of each line as one of n, then as one of n - 1, words."""
    n = x.end - x.start
    out = []
    for m in (n, n - 1):
        half = m // 2
        salt = mix(m.astype(U64) * U64(4))
        out.append(mix(spans(x.name, x.start, x.start + half) + salt))
        out.append(mix(spans(x.name, x.end - (m - half), x.end) + salt + U64(1)))
    return np.stack(out, axis=1)


def _exact(x: Lines) -> np.ndarray:
    """A key of each line that only lines of the same words have; no variant of a longer line has it."""
    return mix(spans(x.name, x.start, x.end) + mix((x.end - x.start).astype(U64) * U64(4)) + U64(2))


def _again(name: np.ndarray) -> np.ndarray:
    """Second names of words, for the hash that confirms a key."""
    return mix(name ^ U64(0xC2B2AE3D27D4EB4F))


def _kind(place: np.ndarray, again: np.ndarray) -> np.ndarray:
    """The place of the lost word (-1: none) and 32 bits of the second hash, in one number."""
    return (signed(again) >> 32 << 32) | (place & 0xFFFFFFFF)


def _texts(batch: pa.RecordBatch, short: bool):
    """(doc_ids, lines that may have near copies, shorter lines) of some texts at a time."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, cut = buffers(batch.column(1))
    for lo, hi in runs(cut):
        x = lines(raw[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo], 1 if short else MIN_WORDS)
        near = x.end - x.start >= MIN_WORDS
        yield ids[lo:hi], x.where(near), x.where(~near)


def _listed(batch: pa.RecordBatch, short: bool):
    for _, x, brief in _texts(batch, short):
        keys, whole = _halves(x), _exact(brief)
        owner = np.repeat(np.arange(len(keys)), 4), np.arange(len(whole)) + len(keys)
        yield np.concatenate([keys.ravel(), whole]), np.concatenate(owner)


def variants(x: Lines, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, kind, line) of the variants that could meet another line's."""
    if not len(x.start):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = x.end - x.start
    met = postings.is_shared(table, _halves(x).ravel()).reshape(-1, 4)
    # A word may be lost in the first half if the second is shared, and the other way round; the halves
    # of a line taken as one of n - 1 words leave the middle to either.
    middle = (n + 1) // 2
    lo = np.where(met[:, 1] | met[:, 3], 0, (n - 1) // 2)
    hi = np.where(met[:, 0] | met[:, 2], n, middle)
    some = met.any(axis=1)
    lo, hi = np.where(some, lo, 0), np.where(some, hi, 0)
    count = hi - lo
    line = np.repeat(np.arange(len(n)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[line]
    own = np.flatnonzero(some)

    def keys(name: np.ndarray) -> np.ndarray:
        up, down = powers(len(name) + 1)
        total = np.zeros(len(name) + 1, U64)
        np.cumsum(name * up[: len(name)], out=total[1:])
        # Behind the lost word every word stands one place further left.
        start, end, at = x.start[line], x.end[line], x.start[line] + place
        less = (total[at] - total[start]) * down[start] + (total[end] - total[at + 1]) * down[start + 1]
        less = mix(less + mix((end - start - 1).astype(U64)))
        start, end = x.start[own], x.end[own]
        return np.concatenate([less, mix((total[end] - total[start]) * down[start] + mix((end - start).astype(U64)))])

    places = np.concatenate([place, np.full(len(own), -1)])
    return keys(x.name), _kind(places, keys(_again(x.name))), np.concatenate([line, own])


def _resolve(h, kind, ids, position, mark):
    """(entries with an earlier line within the bound, the entries of each key and place that others must know).

    Entries of equal key, confirmed by the second hash in `kind`, are lines that
    agree when they lose the word at the place in `kind` (-1: none).  Those meet
    that lost none, and those at the same place.  Only lines of a smaller doc_id,
    or of the same row, are earlier.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, again = kind.astype(np.int32), kind >> 32
    order = np.lexsort((position, mark, ids, place, again, h))
    hs, ag, ks, i, m, p = h[order], again[order], place[order], ids[order], mark[order], position[order]
    new_key = np.r_[True, (hs[1:] != hs[:-1]) | (ag[1:] != ag[:-1])]
    new_place = new_key | np.r_[True, ks[1:] != ks[:-1]]
    new_row = new_place | np.r_[True, (i[1:] != i[:-1]) | (m[1:] != m[:-1])]
    key, all_ = np.cumsum(new_key) - 1, np.arange(len(order))

    def head(fresh):
        return np.flatnonzero(fresh)[np.cumsum(fresh) - 1]

    def earlier(e, at):
        return (i[e] < i[at]) | ((i[e] == i[at]) & (m[e] == m[at]) & (p[e] < p[at]))

    late = earlier(head(new_place), all_) | earlier(head(new_row), all_)  # agree at the same place
    first = head(new_key)
    lost = ks != -1
    whole_first = (ks[first] == -1) & lost
    late |= whole_first & earlier(first, all_)  # lost a word, and an earlier line lost none
    best = np.flatnonzero(lost)
    best = best[np.lexsort((p[best], m[best], i[best], key[best]))]
    lead = best[np.r_[True, key[best][1:] != key[best][:-1]]] if len(best) else best
    partner = np.full(key[-1] + 1, -1)
    partner[key[lead]] = lead
    mine = np.flatnonzero(~lost & (partner[key] >= 0))
    late[mine] |= earlier(partner[key[mine]], mine)  # lost none, and an earlier line lost a word
    return order[late], order[i == i[head(new_place)]]


def late_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, mark, positions): numbers of the lines with an earlier near copy."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = postings.bucket_bits(rows)
    table = postings.shared_bits(rows, bits, lambda batch: _listed(batch, short))

    def entries(batch):
        for ids, x, brief in _texts(batch, short):
            key, kind, line = variants(x, table.value)
            whole = _exact(brief)
            met = np.flatnonzero(postings.is_shared(table.value, whole))
            confirmed = _kind(np.full(len(met), -1), _exact(brief._replace(name=_again(brief.name)))[met])
            key, kind = np.concatenate([key, whole[met]]), np.concatenate([kind, confirmed])
            text, number = (np.concatenate([a[line], b[met]]) for a, b in ((x.text, brief.text), (x.number, brief.number)))
            yield key, kind, text, number, ids, x.mark

    return postings.later(rows, bits, entries, _resolve)


def dedup(docs: DataFrame, short: bool = False) -> DataFrame:
    """`docs` with `text` less its late lines, and the columns n_lines and n_removed (0 for null texts).

    `short`: exact repeats of lines under MIN_WORDS words go too.
    """
    renamed = docs.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    keys = {"doc_id": docs.columns.index("doc_id"), "text": docs.columns.index("text")}
    rows = renamed.withColumns({"doc_id": F.col(f"_{keys['doc_id']}").cast("long")})
    placed = postings.with_places(rows, late_lines(docs, short)).drop("doc_id")
    plain = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    schema = plain.withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)}).schema
    order = [docs.columns.index(c) for c in plain.columns]
    at, names = keys["text"], schema.names

    def cut(batches):
        for b in batches:
            texts, total, removed = [], [], []
            for text, places in zip(b.column(at), b.column(b.num_columns - 1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else None
                gone: list[int] = []
                if places.is_valid and data:
                    mark = text_mark(data)
                    gone = [i for p in places.as_py() if p["mark"] == mark for i in np.frombuffer(p["positions"], np.uint32)]
                total.append(0 if data is None else data.count(b"\n") + 1)
                removed.append(len(gone))
                if gone:
                    keep = np.ones(total[-1], bool)
                    keep[gone] = False
                    data = b"\n".join(compress(data.split(b"\n"), keep))
                texts.append(data)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in order]
            columns += [pa.array(total, pa.int32()), pa.array(removed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(cut, schema)
