"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence.  The linear
program (fewest sequences that cover every length's count) is solved by
multiplicative weights: each round prices the lengths, a knapsack dynamic
program finds the configurations of most value, and lengths lose weight as
they are covered.  The fractional solution is rounded to whole sequences, the
program is solved again for what is left of the histogram, and the little that
no full sequence takes goes best-fit, longest first.  All of this
works on one count per length, so it takes the same time for any corpus;
which document takes which place is then arithmetic on its rank among the
pieces of its length.

A null text is an empty one (its end id alone is packed).  Rows with the same
or a null doc_id are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most value that fits c tokens; item[c]: the index of a length to take there, or -1."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    known = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        total = best[c - lengths[: known[c]]] + value[: known[c]]
        j = int(total.argmax())
        best[c], item[c] = (total[j], j) if total[j] > best[c - 1] else (best[c - 1], -1)
    return best, item


def filled(item: np.ndarray, lengths: np.ndarray, c: int) -> list[int]:
    """The lengths (by index) that knapsack() puts into c tokens."""
    out = []
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            out.append(int(item[c]))
            c -= int(lengths[item[c]])
    return out


class Solution(NamedTuple):
    """A fractional solution that covers every length, its value, and a value that no solution is below."""

    use: dict[tuple[int, ...], float]
    value: float
    bound: float


def fractional(
    lengths: np.ndarray, count: np.ndarray, capacity: int, rounds: int = 60, rate: float = 0.6, slack: float = 0.003
) -> Solution:
    """Multiplicative weights for the covering program: a weight a length, which falls as the length is covered.

    A round prices the lengths once.  For each length, least covered first, the best configuration that
    holds it is used where its value at the weights of the moment is within `slack` of the round's best;
    weights only fall, so it is as near to the best of the moment.  Each round's prices also bound the optimum.
    """
    weight, got, use, bound = np.ones(len(lengths)), np.zeros(len(lengths)), {}, 0.0
    for _ in range(rounds):
        price = lengths * weight
        best, item = knapsack(price, lengths, capacity)
        bound = max(bound, float((count * price).sum() / best[capacity]))
        good = np.flatnonzero(price + best[capacity - lengths] >= (1 - slack) * best[capacity])
        for j in good[np.argsort((got / count)[good], kind="stable")].tolist():
            config = tuple(sorted([j, *filled(item, lengths, capacity - int(lengths[j]))]))
            parts = Counter(config)
            if sum(n * price[i] for i, n in parts.items()) < (1 - slack) * best[capacity]:
                continue
            amount = min(count[i] / n for i, n in parts.items())
            use[config] = use.get(config, 0.0) + amount
            for i, n in parts.items():
                got[i] += n * amount
                weight[i] *= np.exp(-rate * n * amount / count[i])
                price[i] = lengths[i] * weight[i]
    # Scaled so that few lengths lack cover; those get sequences of their own.
    alone = capacity // lengths
    most = None
    for scale in np.unique(np.quantile(got / count, np.linspace(0, 1, 101))):
        if scale > 0:
            lack = np.maximum(count - got / scale, 0)
            value = sum(use.values()) / scale + (lack / alone).sum()
            if most is None or value < most[0]:
                most = value, scale, lack
    value, scale, lack = most
    scaled = {c: x / scale for c, x in use.items()}
    for i in np.flatnonzero(lack > 0).tolist():
        own = (i,) * int(alone[i])
        scaled[own] = scaled.get(own, 0.0) + lack[i] / alone[i]
    return Solution(scaled, float(value), bound)


def best_fit(lengths: np.ndarray, count: np.ndarray, capacity: int) -> Counter:
    """Best-fit, longest first, on the histogram: configurations with whole multiplicities."""
    open_: dict[int, Counter] = defaultdict(Counter)  # by room left
    room = np.zeros(capacity + 1, bool)
    for j in range(len(lengths) - 1, -1, -1):
        size, left = int(lengths[j]), int(count[j])
        while left:
            at = np.flatnonzero(room[size:])
            if len(at):
                r = size + int(at[0])
                config, k = open_[r].popitem()
                if k > left:
                    open_[r][config] = k - left
                    k = left
                room[r] = bool(open_[r])
                open_[r - size][(*config, j)] += k
                room[r - size] = True
                left -= k
            else:
                fit = capacity // size
                for n, k in ((fit, left // fit), (left % fit, 1)):
                    if n and k:
                        open_[capacity - n * size][(j,) * n] += k
                        room[capacity - n * size] = True
                left = 0
    out: Counter = Counter()
    for configs in open_.values():
        for c, k in configs.items():
            out[tuple(sorted(c))] += k
    return out


class Packing(NamedTuple):
    """Whole multiplicities of configurations; `rounded` says which of them come from the program."""

    all: Counter
    rounded: Counter
    gap: float  # of the first turn's fractional solution to its bound


def configurations(lengths: np.ndarray, count: np.ndarray, capacity: int, turns: int = 3, least: float = 0.25) -> Packing:
    """Whole multiplicities that use every piece exactly once.

    The program is solved and rounded in turns.  Rounding goes from configurations of few pieces to
    those of many, as small pieces fill what is left best, and takes each up to twice its share of
    the solution while its pieces last; only full sequences are taken, and what is left is the next
    turn's histogram.  A turn that places less than `least` of it is the last.  The rest goes best-fit.
    """
    left, rounded, gap = count.copy(), Counter(), 0.0
    for turn in range(turns):
        own = np.flatnonzero(left)
        if not len(own):
            break
        before, found = int(left.sum()), fractional(lengths[own], left[own].astype(float), capacity)
        gap = gap if turn else found.value / found.bound - 1
        full = [(tuple(own[list(c)].tolist()), x) for c, x in found.use.items() if lengths[own[list(c)]].sum() == capacity]
        full.sort(key=lambda e: (len(e[0]), -e[1], e[0]))
        for config, x in full:
            parts = Counter(config)
            k = min(int(np.ceil(2 * x)), *(int(left[i]) // n for i, n in parts.items()))
            if k > 0:
                rounded[config] += k
                for i, n in parts.items():
                    left[i] -= n * k
        if before - left.sum() < least * before:
            break
    return Packing(rounded + best_fit(lengths, left, capacity), rounded, gap)


def layout(configs: Counter, lengths: np.ndarray) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, pieces in a sequence, first offset), by rank."""
    rows, rank, sequence = defaultdict(list), Counter(), 0
    for config, k in sorted(configs.items()):
        offset = 0
        for j, n in sorted(Counter(config).items()):
            size = int(lengths[j])
            rows[size].append((rank[size], sequence, n, offset))
            rank[size] += n * k
            offset += n * size
        sequence += k
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document, with their rank among the task's pieces of the same length."""

    def pieces(batches):
        enc, end, seen = encoder(tokenizer), np.uint32(end_id).tobytes(), [0] * (capacity + 1)
        task = TaskContext.get().partitionId()
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = memoryview(enc.ids(text.as_py()) + end)
                n = len(ids) // 4
                at, to, k = 0, n % capacity or capacity, 0
                while at < n:
                    out.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), task, seen[to - at]))
                    seen[to - at] += 1
                    at, to, k = to, to + capacity, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """One row per piece: where it was cut and where it is packed (PLACED)."""
    spark = docs.sparkSession
    pieces = shared.written(cut_pieces(docs, tokenizer, end_id, capacity))
    by_task = pieces.groupBy("task", F.col("length").alias("size")).agg(F.count("*").alias("n"))
    # At most `capacity` rows come to the driver, whatever the corpus.
    counts = sorted((r["size"], r["n"]) for r in by_task.groupBy("size").agg(F.sum("n").alias("n")).collect())
    lengths = np.array([c[0] for c in counts], np.int64)
    number = np.array([c[1] for c in counts], np.int64)
    places = spark.sparkContext.broadcast(layout(configurations(lengths, number, capacity).all, lengths) if counts else {})

    order = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "size", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    ranked = pieces.withColumnRenamed("length", "size").join(base, ["task", "size"])

    def place(batches):
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("task_rank").to_numpy() + b.column("base").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(size) else []:
                rows = places.value[int(size[at[0]])]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                within = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + within // row[:, 2]
                offset[at] = row[:, 3] + within % row[:, 2] * size[at]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "size", "ids_crc32")]
            names = [x.split()[0] for x in PLACED.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(place, PLACED)
