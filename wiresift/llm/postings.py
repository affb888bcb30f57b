"""Hashes that must meet across documents, moved as arrays and not as rows.

A map task lists the hashes of its documents; a bucket is a range of hash
values, and a row of the exchange is all that one task has for one bucket.
Each task first settles what it can by itself and sends one document for a
hash, so a hash that a third of all documents share costs one entry a task.
The number of buckets grows with the text, so that each stays small; Spark
shuffles and retries them like any rows.

`shared_bits` marks, in a bit table of fixed size, the hashes that at least
two documents have.  `later` finds the places whose hash stands in an earlier
document too, and returns them by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .kernel import U64, mix, release

#: bits of the table that goes to every task: 16 MB
TABLE_BITS = 27
#: bits of a hash that are told apart when sharing is found
TOLD_BITS = 40
#: text of a bucket
BUCKET_BYTES = 8 << 20


def bucket_bits(docs: DataFrame, column: str = "text") -> int:
    """log2 of the number of buckets: one for so much text and one for each shuffle partition, at least."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    wanted = max(size // BUCKET_BYTES, shared.shuffle_width(docs.sparkSession) - 1)
    return min(24, max(3, int(wanted).bit_length()))


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def shared_bits(docs: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]):
    """A broadcast bit table of the hashes that two documents (or two `owners`) have.

    hashes(batch) yields (hash, owner) arrays, owners ascending within each.
    """
    spark = docs.sparkSession

    def settle(once, twice):
        merged = np.sort(np.concatenate(once))
        repeated = merged[1:][merged[1:] == merged[:-1]]
        return [np.unique(merged)], [np.unique(np.concatenate([*twice, repeated]))]

    def listed(batches):
        once, twice = [], []
        for b in batches:
            for h, owner in hashes(b):
                if not len(h):
                    continue
                h = (h >> U64(64 - TOLD_BITS)).astype(np.int64)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                again = h[1:] == h[:-1]
                twice.append(np.unique(h[1:][again & (owner[1:] != owner[:-1])]))
                once.append(h[np.r_[True, ~again]])
                if sum(map(len, once[1:])) > max(1 << 20, len(once[0])):
                    once, twice = settle(once, twice)
        if not once:
            return
        (once,), (twice,) = settle(once, twice)
        edges = np.arange((1 << bits) + 1, dtype=np.int64) << (TOLD_BITS - bits)
        one, two = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        low = (1 << (TOLD_BITS - bits)) - 1
        rows = [k for k in range(1 << bits) if one[k + 1] > one[k] or two[k + 1] > two[k]]
        columns = [
            pa.array(rows, pa.int32()),
            pa.array([_pack((once[one[k] : one[k + 1]] & low).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5]) for k in rows], pa.binary()),
            pa.array([_pack((twice[two[k] : two[k + 1]] & low).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5]) for k in rows], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "once", "twice"])
        del once, twice, columns
        release()

    def unpacked(column) -> np.ndarray:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        return wide.view(np.int64).ravel()

    def told(table: pa.Table) -> pa.Table:
        once = np.sort(unpacked(table.column("once")))
        hit = np.concatenate([once[1:][once[1:] == once[:-1]], unpacked(table.column("twice"))])
        flags = np.zeros(1 << (TABLE_BITS - bits), bool)
        flags[hit >> (TOLD_BITS - TABLE_BITS)] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "flags": [np.packbits(flags).tobytes()]})

    found = docs.mapInArrow(listed, "bucket int, once binary, twice binary")
    parts = found.groupBy("bucket").applyInArrow(told, "bucket int, flags binary")
    size = (1 << TABLE_BITS - bits) // 8
    out = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():  # 2 ** TABLE_BITS bits in all
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["flags"], np.uint8)
    return spark.sparkContext.broadcast(out)


def is_shared(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether two documents may have each hash; never wrongly false."""
    at = (h >> U64(64 - TABLE_BITS)).astype(np.int64)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _grouped(ids: np.ndarray, marks: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places by document: (ids, marks, number of places of each, the places), sorted, each place once."""
    order = np.lexsort((position, marks, ids))
    ids, marks, position = ids[order], marks[order], position[order].astype(np.uint32)
    new = np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])] if len(ids) else np.zeros(0, bool)
    keep = new | np.r_[True, position[1:] != position[:-1]] if len(ids) else new
    ids, marks, position, new = ids[keep], marks[keep], position[keep], new[keep]
    head = np.flatnonzero(new)
    return ids[head], marks[head], np.diff(np.r_[head, len(ids)]).astype(np.uint32), position


SENT = "bucket int, hash binary, kind binary, owner binary, position binary, ids binary, marks binary"
PARTS = "part int, ids binary, marks binary, counts binary, positions binary"
FOUND = "doc_id long, _places array<struct<mark:long,positions:binary>>"


def later(
    docs: DataFrame,
    bits: int,
    entries: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]],
    resolve: Callable[..., tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """Places whose hash stands in an earlier place too: one row (doc_id, _places) a document.

    entries(batch) yields (hash, kind, text, position, doc_id of each text,
    mark of each text): an entry is a hash at a position of a text, `kind` (64
    bits) says what may meet what.  resolve(hash, kind, doc_id, position, mark) says which
    entries are later than a match, and which of the others a task must send
    for those of other tasks.  `mark` tells apart rows that carry the same doc_id.
    """
    sent_names, part_names = ([x.split()[0] for x in t.split(", ")] for t in (SENT, PARTS))

    def by_part(ids: np.ndarray, marks: np.ndarray, position: np.ndarray) -> Iterator[tuple]:
        """(part, ids, marks, counts, positions): the places of the documents of each part."""
        ids, marks, counts, position = _grouped(ids, marks, position)
        part = (mix(ids.view(U64)) >> U64(64 - bits)).astype(np.int64)
        of_place = np.repeat(part, counts)
        by, at = np.argsort(part, kind="stable"), np.argsort(of_place, kind="stable")
        edges = np.arange((1 << bits) + 1)
        doc, place = np.searchsorted(part[by], edges), np.searchsorted(of_place[at], edges)
        for k in np.unique(part):
            own = by[doc[k] : doc[k + 1]]
            yield int(k), _pack(ids[own]), _pack(marks[own]), _pack(counts[own]), _pack(position[at[place[k] : place[k + 1]]])

    def listed(batches):
        parts, ids, marks, texts = [], [], [], 0
        for b in batches:
            for h, kind, text, position, doc_id, mark in entries(b):
                parts.append((h, kind, text + texts, position))
                ids.append(doc_id)
                marks.append(mark)
                texts += len(doc_id)
        if not texts:
            return
        h, kind, text, position = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        ids, marks = np.concatenate(ids), np.concatenate(marks)
        done, first = resolve(h, kind, ids[text], position, marks[text])
        kinds = [pa.int32(), *[pa.binary()] * 6]

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=sent_names)

        for k, i, m, counts, places in by_part(ids[text[done]], marks[text[done]], position[done]):
            yield row(k, None, None, counts, places, i, m)  # settled here; passes through
        h, kind, text, position = h[first], kind[first], text[first], position[first]
        order = np.argsort(h, kind="stable")
        h, kind, text, position = h[order], kind[order], text[order], position[order]
        edges = np.r_[np.searchsorted(h, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), len(h)]
        for k in range(1 << bits):
            a, z = int(edges[k]), int(edges[k + 1])
            if z > a:
                own, owner = np.unique(text[a:z], return_inverse=True)
                arrays = h[a:z], kind[a:z].astype(np.int64), owner.astype(np.uint32), position[a:z].astype(np.uint32), ids[own], marks[own]
                yield row(k, *map(_pack, arrays))
        del h, kind, text, position, done, first, order
        release()

    def met(table: pa.Table) -> pa.Table:
        parts, ids, marks, n, out = [], [], [], 0, []
        for r in table.to_pylist():
            own, mark = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64)
            owner, position = np.frombuffer(r["owner"], np.uint32), np.frombuffer(r["position"], np.uint32)
            if r["hash"] is None:
                out.append((np.repeat(own, owner), np.repeat(mark, owner), position))
                continue
            parts.append((np.frombuffer(r["hash"], U64), np.frombuffer(r["kind"], np.int64), owner.astype(np.int64) + n, position))
            ids.append(own)
            marks.append(mark)
            n += len(own)
        if parts:
            h, kind, text, position = (np.concatenate(c) for c in zip(*parts))
            ids, marks = np.concatenate(ids), np.concatenate(marks)
            done, _ = resolve(h, kind, ids[text], position, marks[text])
            out.append((ids[text[done]], marks[text[done]], position[done]))
        rows = list(by_part(*(np.concatenate(c) for c in zip(*out)))) if out else []
        columns = zip(*rows) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 4])], names=part_names)

    def gathered(table: pa.Table) -> pa.Table:
        out = []
        for r in table.to_pylist():
            counts = np.frombuffer(r["counts"], np.uint32)
            ids, marks = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64)
            out.append((np.repeat(ids, counts), np.repeat(marks, counts), np.frombuffer(r["positions"], np.uint32)))
        ids, marks, counts, position = _grouped(*(np.concatenate(c) for c in zip(*out)))
        ends = np.cumsum(counts)
        by_doc: dict[int, list] = {}
        for i, m, a, z in zip(ids.tolist(), marks.tolist(), (ends - counts).tolist(), ends.tolist()):
            by_doc.setdefault(i, []).append({"mark": m, "positions": position[a:z].tobytes()})
        places = pa.array(list(by_doc.values()), pa.list_(pa.struct([("mark", pa.int64()), ("positions", pa.binary())])))
        return pa.table([pa.array(list(by_doc), pa.int64()), places], names=["doc_id", "_places"])

    sent = docs.mapInArrow(listed, SENT).groupBy("bucket").applyInArrow(met, PARTS)
    return sent.groupBy("part").applyInArrow(gathered, FOUND)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """`docs` with the column `_places`, a list of (mark, positions) of their doc_id, or null."""
    by_doc = places.withColumnRenamed("doc_id", "_id")
    return docs.join(by_doc.hint("shuffle_hash"), docs["doc_id"] == by_doc["_id"], "left").drop("_id")
