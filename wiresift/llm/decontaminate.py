"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are word sequences (ASCII lower-cased, letters,
digits and non-ASCII).  Hashes of MIN_MATCH words, Karp-Rabin style, are the
seeds that join documents with items; the seeds of a document and an item,
merged along their diagonals, are maximal common runs.  Tiling takes the
longest run first, marks its words on both sides, cuts what is left of
overlapping runs, and goes on until no run of MIN_MATCH words is unmarked.  An
item is leaked by a document whose tiles cover enough of the item, in whatever
order they stand; the words of a tile are compared themselves.

To cover an item, a document must hold so many of its seeds that it holds one
of the rarest of them, all but that number less one.  So only an item's rarer
seeds join, and a phrase that many items share pairs nothing by itself.  A bit
table of fixed size, made from those seeds, tells which documents to look at:
one pass over the documents serves a benchmark of any size.

Null or empty texts match nothing; an item of fewer than MIN_MATCH words can't
be told from chance and never counts.  Rows with the same or a null id are
judged each; an item row counts for itself.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .kernel import WORDY, U64, Words, buffers, grams, runs, signed, words

MIN_MATCH = 4
#: bits of the table that tells which documents to look at (2 MB)
FILTER_BITS = 24
#: pairs of a document's and an item's seeds that are laid out at once
PAIRS = 1 << 20
#: items of one row that a document meets
ITEMS_A_ROW = 1024
FOUND = "doc_id long, mark long, size int, item_id long, item_words int, covered_words int, tiles int, longest_tile int"
_KINDS = {"long": pa.int64(), "int": pa.int32()}


def tiling(doc_at: np.ndarray, item_at: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """The greedy tiles (length, place in the document, place in the item), given the seeds of both.

    `size`: words of the item.  Of equally long matches the first in the document, then in the item, is taken.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    d, t = doc_at[order], item_at[order]
    first = np.r_[True, (np.diff(d) != 1) | (np.diff(d - t) != 0)]
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(d)]) + k - 1
    tiles: list[tuple[int, int, int]] = []
    _mark([(-int(n), int(d[s]), int(t[s])) for s, n in zip(start, length)], k, np.zeros(size, bool), set(), tiles)
    return tiles


def _mark(heap: list[tuple[int, int, int]], least: int, done_item: np.ndarray, done_doc: set, tiles: list) -> None:
    """Takes the longest free runs (-length, places) of `least` words or more, one after another."""
    heapq.heapify(heap)
    while heap and not done_item.all():
        n, a, b = heapq.heappop(heap)
        free = [not done_item[b + i] and a + i not in done_doc for i in range(-n)]
        if all(free):
            tiles.append((-n, a, b))
            done_item[b : b - n] = True
            done_doc.update(range(a, a - n))
            continue
        i = 0
        while i < -n:  # the parts between what was marked meanwhile
            j = i
            while j < -n and free[j]:
                j += 1
            if j - i >= least:
                heapq.heappush(heap, (i - j, a + i, b + i))
            i = j + 1


def _free_runs(order, first, n, k: int, least: int, done_item: np.ndarray, done_doc: set) -> list[tuple[int, int, int]]:
    """Maximal unmarked runs of `least` words or more, found in stretches of the document of PAIRS seed pairs.

    Document place p meets the item places order[first[p] : first[p] + n[p]].
    """
    size, places = len(done_item), len(n)
    marked = np.zeros(places + k, bool)
    marked[[p for p in done_doc if p < len(marked)]] = True
    item_free = _windows(done_item, k)
    doc_free = _windows(marked, k)[:places]
    n = np.where(doc_free, n, 0)
    upto = np.concatenate([[0], np.cumsum(n)])
    out, open_runs, lo = [], {}, 0
    while lo < places:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        m = n[lo:hi]
        d = np.repeat(np.arange(lo, hi), m)
        t = order[np.repeat(first[lo:hi] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        keep = item_free[t]
        d, t = d[keep], t[keep]
        by = np.lexsort((d, d - t))
        d, t = d[by], t[by]
        start = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(d - t) != 0)]) if len(d) else np.zeros(0, np.int64)
        stop = np.r_[start[1:], len(d)][: len(start)].astype(np.int64) - 1
        still = {}
        head = d[start] == lo
        tail = d[stop] == hi - 1
        length = stop - start + k
        # Runs that lie inside the stretch are done; those at its ends may go on.
        for i in np.flatnonzero(~head & ~tail & (length >= least)):
            out.append((-int(length[i]), int(d[start[i]]), int(t[start[i]])))
        for i in np.flatnonzero(head | tail):
            a, b, z = int(d[start[i]]), int(t[start[i]]), int(d[stop[i]])
            if head[i]:
                a, b = open_runs.pop(a - b, (a, b))
            if tail[i]:
                still[a - b] = (a, b)
            elif z - a + k >= least:
                out.append((a - z - k, a, b))
        out += [(a - lo - k + 1, a, b) for a, b in open_runs.values() if lo - 1 - a + k >= least]
        open_runs, lo = still, hi
    out += [(a - places - k + 1, a, b) for a, b in open_runs.values() if places - 1 - a + k >= least]
    return out


def _windows(marked: np.ndarray, k: int) -> np.ndarray:
    """Is each place the start of k unmarked words?"""
    sums = np.concatenate([[0], np.cumsum(marked)])
    out = np.zeros(len(marked), bool)
    if len(marked) >= k:
        out[: len(marked) - k + 1] = sums[k:] == sums[:-k]
    return out


def _seeds(benchmark: DataFrame, k: int) -> DataFrame:
    """(hash, item, words): the seeds of every item at all of its places; `item` numbers the rows."""

    def each(batches):
        for b in batches:
            raw, cut = buffers(b.column(1))
            w = words(raw, cut, WORDY)
            h, ok = grams(w, k)
            at = np.flatnonzero(ok)
            owner = w.text_of()[at]
            size = np.diff(w.cut).astype(np.int32)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), b.column(0).take(pa.array(owner)), pa.array(size)], names=["hash", "item", "words"])

    return benchmark.select("item", "text").mapInArrow(each, "hash long, item long, words int")


def _rare_seeds(seeds: DataFrame, coverage: float, k: int) -> DataFrame:
    """(hash, item): the rarest seeds of every item, one of which any document that covers it has.

    Tiles of k words cover most for the seeds they need: coverage * words / k seeds at least are shared.
    """
    held = seeds.groupBy("hash").agg(F.count_distinct("item").alias("items"))
    needed = F.greatest(F.lit(1), F.ceil(coverage * F.col("words") / k - 1e-9))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "hash"))
    ranked = seeds.join(held, "hash").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("words") - k + 1 - needed + 1).select("hash", "item").distinct()


def _filter(rare: DataFrame) -> np.ndarray:
    """A bit for each hash value that a rare seed has, as 32-bit words."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bits = rare.select(slot.alias("slot")).selectExpr("slot >> 5 AS word", "1L << cast(slot & 31 AS int) AS bit")
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for b in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():  # as many rows as `out`, at most
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    return out


def _hit_documents(docs: DataFrame, table: np.ndarray, k: int) -> DataFrame:
    """(row, doc_id, text, hashes) of the documents with a seed in the table; `row` numbers them."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def each(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            raw, cut = buffers(b.column(1))
            for lo, hi in runs(cut):
                w = words(raw[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo], WORDY)
                h, ok = grams(w, k)
                slot = (h >> U64(64 - FILTER_BITS)).astype(np.int64)
                at = np.flatnonzero(ok & (held.value[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool))
                if not len(at):
                    continue
                owner = np.searchsorted(w.cut, at, "right") - 1
                hit, first = np.unique(owner, return_index=True)
                own = [np.unique(x) for x in np.split(h[at], first[1:])]
                edges = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(signed(np.concatenate(own))))
                rows = pa.array(row + np.arange(len(hit)))
                row += len(hit)
                part = b.slice(lo, hi - lo).take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([rows, part.column(0), part.column(1), lists], names=["row", "doc_id", "text", "hashes"])

    return docs.mapInArrow(each, "row long, doc_id long, text string, hashes array<long>")


def _spelled(w: Words, start: int, n: int) -> list[bytes]:
    return [w.buffer[a:z].tobytes().lower() for a, z in zip(w.start[start : start + n], w.end[start : start + n])]


def tiles_of(d: Words, seeds: np.ndarray, t: Words, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of a document, whose seeds are given, and an item; colliding hashes make none."""
    own, ok = grams(t, k)
    own = own[ok]
    order = np.argsort(own, kind="stable")
    first, last = np.searchsorted(own[order], seeds, "left"), np.searchsorted(own[order], seeds, "right")
    n = last - first
    pairs, found, least = int(n.sum()), [], len(t.name)
    if pairs > PAIRS:  # repetitive on both sides: longer matches first, so that the product of the two is never laid out
        done_item, done_doc = np.zeros(len(t.name), bool), set()
        while not done_item.all():
            least = max(k, least // 2)
            _mark(_free_runs(order, first, n, k, least, done_item, done_doc), least, done_item, done_doc, found)
            if least == k:
                break
    elif pairs:
        doc_at = np.repeat(np.arange(len(seeds)), n)
        item_at = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(pairs)]
        found = tiling(doc_at, item_at, k, len(t.name))
    return [x for x in found if _spelled(d, x[1], x[0]) == _spelled(t, x[2], x[0])]


def _judged(coverage: float, k: int):
    def each(batches):
        for b in batches:
            out = []
            for doc, mark, text, items in zip(*(b.column(c) for c in ("doc_id", "mark", "text", "items"))):
                d = words(*buffers(pa.array([text.as_py()])), WORDY)
                seeds, ok = grams(d, k)
                # A word's last places have no seed; the value that stands there meets nothing.
                seeds = seeds[: int(ok.sum())]
                for item in items.as_py():
                    t = words(*buffers(pa.array([item["text"]])), WORDY)
                    size, tiles = len(t.name), [x[0] for x in tiles_of(d, seeds, t, k)]
                    if tiles and sum(tiles) >= coverage * size:
                        out.append((doc.as_py(), mark.as_py(), len(d.buffer), item["item_id"], size, sum(tiles), len(tiles), max(tiles)))
            names, kinds = zip(*(x.split() for x in FOUND.split(", ")))
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(columns, kinds)], names=names)

    return each


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, k: int) -> DataFrame:
    """FOUND: a row for each document row and item row that it covers; mark and size are the text's hash and bytes."""
    items = benchmark.where(F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = shared.written(items.withColumn("item", F.monotonically_increasing_id()))
    rare = shared.written(_rare_seeds(_seeds(items, k), coverage, k))
    rows = docs.where(F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = shared.written(_hit_documents(rows, _filter(rare), k))
    pairs = hits.select("row", F.explode("hashes").alias("hash")).join(rare, "hash").select("row", "item").distinct()
    # A document's items come to it in rows of about ITEMS_A_ROW at most, so none grows with the benchmark.
    parts = -(-items.count() // ITEMS_A_ROW) or 1
    met = pairs.join(items, "item").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    met = met.groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items")).drop("part")
    joined = hits.select("row", "doc_id", "text", F.xxhash64("text").alias("mark")).join(met, "row")
    return joined.select("doc_id", "mark", "text", "items").mapInArrow(_judged(coverage, k), FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, k: int = MIN_MATCH) -> DataFrame:
    """One row for each document and item that it covers to `coverage` at least."""
    return _found(docs, benchmark, coverage, k).drop("mark", "size")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, k: int = MIN_MATCH) -> DataFrame:
    """Rows that leak no item; columns unchanged."""
    gone = shared.written(_found(docs, benchmark, coverage, k).select("doc_id", "mark", "size").distinct())
    gone = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in gone.columns])
    text = docs["text"].cast("string")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_doc_id"]) & (F.xxhash64(text) == gone["_gone_mark"])
    return docs.join(gone, same & (F.octet_length(text) == gone["_gone_size"]), "left_anti")
