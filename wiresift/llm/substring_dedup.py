"""Substring de-duplication by recompression.

A document's words are named, and rounds of recompression name short runs and
neighbouring pairs: a pair is joined where the left name falls in one class
and the right name in the other, which depends on the two names alone.  Names
are 64-bit hashes of what they stand for, so all tasks agree on them without a
table, and equal passages get equal symbols but for EDGE words at their ends.
Symbols of the last round that two documents share are marked in a bit table.
A window of WINDOW words can repeat only if all symbols in its interior are
shared; windows that pass are then verified by 128 bits of hash over all their
words, and every window that also starts in a document with a smaller id is
removed.

Null texts have no words.  Rows with a null doc_id have no place in the order:
they neither remove words nor lose any.  Rows with equal ids do not remove
each other's words.  Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from .kernel import SPACED, U64, Words, buffers, mix, rolling, runs, signed, text_mark, text_marks, words

WINDOW = 50
#: what makes the second hash of a word
SECOND = U64(0xC2B2AE3D27D4EB4F)
#: words a symbol may stand for, and rounds of pairs
WIDEST, ROUNDS = 6, 4
#: Words at each end of an equal passage whose symbols may differ: a run may begin outside (2), and each
#: round of pairs may take the outermost symbol, of at most 2, 4, 6 and 6 words, into a pair with one outside.
EDGE = 2 + 2 + 4 + 6 + 6


def recompressed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the last round: name, first word, text number."""
    name, owner = w.name, w.text_of()
    at = np.arange(len(name))
    span = np.ones(len(name), np.int64)
    if len(name) > 1:  # runs of exactly two equal words
        same = (name[1:] == name[:-1]) & (owner[1:] == owner[:-1])
        alone = same & ~np.r_[False, same[:-1]] & ~np.r_[same[1:], False]
        name, at, span, owner = _joined(name, at, span, owner, np.flatnonzero(alone), 99)
    for r in range(ROUNDS):
        if len(name) < 2:
            break
        side = (name >> U64(11 + 7 * r)) & U64(1)
        pair = (side[:-1] == 0) & (side[1:] == 1) & (owner[1:] == owner[:-1]) & (span[1:] + span[:-1] <= WIDEST)
        name, at, span, owner = _joined(name, at, span, owner, np.flatnonzero(pair), r)
    return name, at, owner


def _joined(name, at, span, owner, left, salt):
    """Joins each symbol at `left` with the one behind it; no two pairs overlap."""
    name, span = name.copy(), span.copy()
    name[left] = mix(name[left] * U64(0x9FB21C651E98DF25) + name[left + 1] + U64(salt))
    span[left] += span[left + 1]
    keep = np.ones(len(name), bool)
    keep[left + 1] = False
    return name[keep], at[keep], span[keep], owner[keep]


def _texts(batch: pa.RecordBatch):
    """(ids, words) of runs of the batch's texts."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, cut = buffers(batch.column(1))
    for lo, hi in runs(cut):
        yield ids[lo:hi], words(raw[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo], SPACED, lower=False)


def _symbols(batch: pa.RecordBatch):
    for _, w in _texts(batch):
        name, _, owner = recompressed(w)
        yield name, owner


def candidates(w: Words, table: np.ndarray) -> np.ndarray:
    """First words of the windows whose interior symbols are all shared."""
    n = len(w.name)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    name, at, _ = recompressed(w)
    end = np.r_[at[1:], n]
    alone = ~postings.is_shared(table, name)
    # A symbol of words a..b lies in the interior of the windows that start from b - WINDOW + EDGE to a - EDGE.
    a, b = at[alone], end[alone]
    lo, hi = np.maximum(b - (WINDOW - EDGE), 0), a - EDGE + 1
    good = hi > lo
    step = np.bincount(lo[good], minlength=n + 1) - np.bincount(hi[good], minlength=n + 1)
    out = np.cumsum(step[:n]) == 0
    left = np.repeat(w.cut[1:], np.diff(w.cut)) - np.arange(n)
    return np.flatnonzero(out & (left >= WINDOW))


def _resolve(h, kind, ids, position, mark):
    """(entries with the same hashes in a smaller id, entries of the smallest id)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((ids, kind, h))
    hs, ks, i = h[order], kind[order], ids[order]
    fresh = np.r_[True, (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1])]
    least = i[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return order[i > least], order[i == least]


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, positions): first words of windows that also start in a document with a smaller id."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = postings.bucket_bits(rows)
    table = postings.shared_bits(rows, bits, _symbols)

    def entries(batch):
        for ids, w in _texts(batch):
            at = candidates(w, table.value)
            # All words of a window, by two hashes of 64 bits that have nothing in common.
            h, again = (rolling(x, WINDOW)[at] if len(at) else np.zeros(0, U64) for x in (w.name, mix(w.name ^ SECOND)))
            text = np.searchsorted(w.cut, at, "right") - 1
            yield h, signed(again), text, at - w.cut[text], ids, text_marks(w.buffer, w.text_cut)

    return postings.later(rows, bits, entries, _resolve)


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, on request, the kept words as text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = postings.with_places(rows, repeated_windows(docs)).select("doc_id", "text", "_places")

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own = text.as_buffer() if text.is_valid else None
                got = own.to_pybytes().split() if own is not None else []
                n = len(got)
                if places.is_valid and n >= WINDOW:
                    mark = text_mark(own)
                    start = [np.frombuffer(p["positions"], np.uint32) for p in places.as_py() if p["mark"] == mark]
                    if start:
                        step = np.zeros(n + 1, np.int64)
                        for s in start:
                            step += np.bincount(s, minlength=n + 1) - np.bincount(s + np.uint32(WINDOW), minlength=n + 1)
                        got = list(compress(got, (np.cumsum(step[:n]) == 0).tolist()))
                kept = b" ".join(got)
                out.append((doc, n, n - len(got), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in KEPT.split(", ")])

    done = placed.mapInArrow(cut, KEPT)
    return done if with_text else done.drop("kept")
