"""Exact Jaccard join of word-shingle sets, as a join in a metric space.

Jaccard distance is a metric.  Documents that lie within the radius of each
other are found through regions around pivots:

Level 0.  Two sets within the radius share a shingle among the first few of
each in any common order (`prefix`).  A region holds the sets whose prefixes
have a shingle, the pivot being that one-shingle set; a set near the borders of
several regions is copied into each.  Shingles that many sets hold come last
in the order, so common passages make no regions.  Document pivots alone would
not do here: unrelated documents are at distance 1 from every one of them, so
no number of them splits the corpus.

Level 1.  In each region one document is the pivot and the distance of every
other member to it is computed.  Members within the radius are linked to it.

Further levels.  A region all of whose members are now in one component is
finished.  In an open one, members outside its main component become pivots;
the distance of every member to them is computed, members within the radius
are linked, and the rest of the region is cut into the pivots' Voronoi cells.
A member x also goes to the cell of any pivot p that is no more than twice the
radius further than its nearest one: of two documents within the radius of
each other, by the triangle inequality, both stand in the cell of the one's
nearest pivot.  Cells join recursively.  A region whose members would on the
whole go to more than COPIES cells each stays in one piece, so copies don't
pile up where all members are about equally far from all pivots.  A cell with
few members outside its main component, or one that pivots don't cut, is
compared directly, in blocks of bounded size; there too the triangle inequality
holds pairs back whose distances to the cell's pivot differ by more than the
radius.

Sets that are equal are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings, shared
from .components import components
from .kernel import SPACED, U64, buffers, distinct_by_text, grams, mix, release, runs, signed, spans, words

K = 5
#: similarity as a fraction: links need intersection * DEN >= union * NUM
NUM, DEN = 4, 5
#: documents that hold a shingle, at which it moves further back in the order
LEVELS = (6, 50, 400)
#: the order's table: 2 bits for each of so many hash values (16 MB)
ORDER_BITS = 26


def shingles(raw: np.ndarray, cut: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts, sorted in each; the text of each; words of each text.

    A text with some but fewer than k words has its whole sequence as its one shingle.
    """
    w = words(raw, cut, SPACED)
    size = np.diff(w.cut)
    h, ok = grams(w, k)
    h, owner = h[ok], w.text_of()[ok]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = spans(w.name, w.cut[short], w.cut[short + 1])
        h, owner = np.concatenate([h, mix(whole + U64(77))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    h, owner = distinct_by_text(h, owner)
    return h, owner, size


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums by text, wrapping around."""
    total = np.r_[U64(0), np.cumsum(values, dtype=U64)]
    cut = np.searchsorted(owner, np.arange(n + 1))
    return total[cut[1:]] - total[cut[:-1]]


def _classes(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, number of shingles) of each text: equal sets have equal classes."""
    size = np.bincount(owner, minlength=n)
    return mix(_sums(mix(h + U64(1)), owner, n) + size.astype(U64) * U64(0x9E3779B97F4A7C15)), size


def _texts(batch: pa.RecordBatch, at: int):
    raw, cut = buffers(batch.column(at))
    for lo, hi in runs(cut):
        yield lo, hi, *shingles(raw[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo])


def _counts(rows: DataFrame, bits: int) -> tuple[DataFrame, object]:
    """The documents (doc_id, mark, class, n_shingles), written, and the order's table, broadcast.

    One pass over the texts: each task counts its shingles, the counts meet in buckets of
    hash ranges, and a bucket gives its part of the table.
    """
    spark = rows.sparkSession

    def merged(parts):
        values, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        values, n = values[order], n[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else order
        return values[first], np.add.reduceat(n, first) if len(values) else n

    names = ["bucket", "gaps", "more", "ids", "marks", "classes", "sizes"]

    def listed(batches):
        parts, docs = [], 0
        for b in batches:
            ids, marks = b.column(0), b.column(2)
            for lo, hi, h, owner, _ in _texts(b, 1):
                cls, size = _classes(h, owner, hi - lo)
                docs += 1
                row = [docs & ((1 << bits) - 1), None, None, ids.slice(lo, hi - lo).to_pylist(), marks.slice(lo, hi - lo).to_numpy().tobytes()]
                row += [signed(cls).tobytes(), size.astype(np.int64).tobytes()]
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)
                parts.append(np.unique((h >> U64(32)).astype(np.int64), return_counts=True))
                if sum(len(p[0]) for p in parts[1:]) > max(1 << 20, len(parts[0][0])):
                    parts = [merged(parts)]
        if not parts:
            return
        value, n = merged(parts)
        edges = np.searchsorted(value, np.arange((1 << bits) + 1, dtype=np.int64) << (32 - bits))
        for k in range(1 << bits):
            a, z = edges[k], edges[k + 1]
            if z == a:
                continue
            many = np.flatnonzero(n[a:z] > 1)
            more = np.stack([many, n[a:z][many]]).astype(np.uint32)
            row = [k, _gaps(value[a:z] - (k << (32 - bits))), more.tobytes(), None, None, None, None]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)
        del parts, value, n
        release()

    def told(table: pa.Table) -> pa.Table:
        parts, ids, marks, classes, sizes = [], [], [], [], []
        for r in table.to_pylist():
            if r["gaps"] is None:
                ids += r["ids"]
                marks.append(np.frombuffer(r["marks"], np.int64))
                classes.append(np.frombuffer(r["classes"], np.int64))
                sizes.append(np.frombuffer(r["sizes"], np.int64))
                continue
            value = _ungapped(r["gaps"])
            n = np.ones(len(value), np.int64)
            at, more = np.frombuffer(r["more"], np.uint32).reshape(2, -1)
            n[at] = more
            parts.append((value, n))
        columns = [pa.array(ids, pa.int64()), *[pa.array(np.concatenate(x) if ids else [], pa.int64()) for x in (marks, classes, sizes)]]
        columns += [pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
        if parts:
            value, n = merged(parts)
            level = np.zeros(1 << (ORDER_BITS - bits), np.uint8)
            np.maximum.at(level, value >> (32 - ORDER_BITS), np.searchsorted(LEVELS, n, "right").astype(np.uint8))
            four = level.reshape(-1, 4)
            packed = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
            extra = [[None], [None], [None], [None], table.column("bucket").slice(0, 1).to_pylist(), [packed.tobytes()]]
            columns = [pa.concat_arrays([c, pa.array(x, c.type)]) for c, x in zip(columns, extra)]
        return pa.table(columns, names=["doc_id", "mark", "class", "n_shingles", "bucket", "levels"])

    sent = rows.mapInArrow(listed, "bucket int, gaps binary, more binary, ids array<long>, marks binary, classes binary, sizes binary")
    kept = "doc_id long, mark long, class long, n_shingles long, bucket int, levels binary"
    table = shared.written(sent.groupBy("bucket").applyInArrow(told, kept))
    size = (1 << ORDER_BITS - bits) // 4
    levels = np.zeros((1 << ORDER_BITS) // 4, np.uint8)
    for r in table.where(F.col("levels").isNotNull()).select("bucket", "levels").toLocalIterator():  # 16 MB in all
        levels[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    docs = table.where(F.col("levels").isNull()).select("doc_id", "mark", "class", "n_shingles")
    return docs, spark.sparkContext.broadcast(levels)


def _gaps(value: np.ndarray) -> bytes:
    """Ascending values as 16-bit gaps; 65535 says that as much is to be added to the next."""
    step = np.diff(value, prepend=0)
    skips = step // 65535
    out = np.full(len(step) + int(skips.sum()), 65535, np.uint16)
    out[np.arange(len(step)) + np.cumsum(skips)] = step % 65535
    return out.tobytes()


def _ungapped(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, np.uint16).astype(np.int64)
    return np.cumsum(gaps)[gaps != 65535]


def _level(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> U64(64 - ORDER_BITS)).astype(np.int64)
    return table[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3


def prefix(h: np.ndarray, owner: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of each text's prefix (rarest level first, then by hash), their text and their place."""
    key = (_level(table, h).astype(U64) << U64(62)) | (h >> U64(2))
    order = np.lexsort((key, owner))
    size = np.bincount(owner, minlength=n)
    first = np.cumsum(size) - size
    most = size - (NUM * size + DEN - 1) // DEN + 1
    place = np.arange(len(h)) - first[owner]
    take = place < most[owner]
    return h[order][take], owner[take], place[take]


def _regions(rows: DataFrame, table, bits: int) -> DataFrame:
    """(region, class, n, place): the classes of every region that has two or more.

    Regions with the same classes are one; `place` is the earliest of the
    region's shingles in the class's order.
    """
    spark = rows.sparkSession

    def listed(batches):
        parts = []
        for b in batches:
            for lo, hi, h, owner, _ in _texts(b, 1):
                cls, size = _classes(h, owner, hi - lo)
                _, first = np.unique(cls, return_index=True)  # equal sets once
                h, owner, place = prefix(h, owner, hi - lo, table.value)
                keep = np.isin(owner, first)
                parts.append((h[keep], cls[owner[keep]], size[owner[keep]], place[keep].astype(np.uint32)))
        if not parts:
            return
        h, cls, n, place = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, cls, n, place = h[order], cls[order], n[order], place[order]
        edges = np.r_[np.searchsorted(h, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), len(h)]
        for k in range(1 << bits):
            a, z = edges[k], edges[k + 1]
            if z > a:
                own, at = np.unique(cls[a:z], return_inverse=True)
                sizes = np.zeros(len(own), np.int64)
                sizes[at] = n[a:z]
                row = [[k], [h[a:z].tobytes()], [at.astype(np.uint32).tobytes()], [place[a:z].tobytes()], [signed(own).tobytes()], [sizes.tobytes()]]
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["bucket", "hash", "at", "places", "classes", "sizes"])
        del parts, h, cls, n, place, order
        release()

    def met(t: pa.Table) -> pa.Table:
        parts = []
        for r in t.to_pylist():
            at = np.frombuffer(r["at"], np.uint32)
            own, sizes = (np.frombuffer(r[c], np.int64)[at] for c in ("classes", "sizes"))
            parts.append((np.frombuffer(r["hash"], U64), own, sizes, np.frombuffer(r["places"], np.uint32)))
        h, cls, n, place = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((place, cls, h))
        h, cls, n, place = h[order], cls[order], n[order], place[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])]
        h, cls, n, place = h[fresh], cls[fresh], n[fresh], place[fresh]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[head, len(h)])
        # A region is named by its members, so regions with the same ones are one.
        name = mix(np.add.reduceat(mix(cls.view(U64)), head) + count.astype(U64))
        keep = np.repeat(count > 1, count)
        region, cls, n, place = np.repeat(signed(name), count)[keep], cls[keep], n[keep], place[keep]
        order = np.lexsort((place, cls, region))
        region, cls, n, place = region[order], cls[order], n[order], place[order]
        once = np.r_[True, (region[1:] != region[:-1]) | (cls[1:] != cls[:-1])] if len(region) else np.zeros(0, bool)
        return pa.table({"region": region[once], "class": cls[once], "n": n[once], "place": place[once].astype(np.int64)})

    sent = rows.mapInArrow(listed, "bucket int, hash binary, at binary, places binary, classes binary, sizes binary")
    found = sent.groupBy("bucket").applyInArrow(met, "region long, class long, n long, place long")
    return shared.written(found.groupBy("region", "class").agg(F.first("n").alias("n"), F.min("place").alias("place")))


def _sets(rows: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted classes, each from one of its texts.

    A bit table of fixed size says which texts to look at, so that texts stay where they are.
    """
    spark = rows.sparkSession
    first = docs.join(wanted, "class").groupBy("class").agg(F.min("mark").alias("mark"))
    slot = F.shiftrightunsigned(F.xxhash64("mark"), 64 - postings.TABLE_BITS)
    marked = first.select(slot.alias("slot")).selectExpr("slot >> 5 AS word", "1L << cast(slot & 31 AS int) AS bit")
    marked = marked.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (postings.TABLE_BITS - 5), np.uint32)
    for b in marked.toArrow().to_batches():  # as many rows as the table has words, at most
        table[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    held = spark.sparkContext.broadcast(table)
    slotted = rows.select("text", slot.alias("slot"))

    def listed(batches):
        for b in batches:
            at = b.column(1).to_numpy()
            keep = (held.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
            b = b.filter(pa.array(keep))
            for lo, hi, h, owner, _ in _texts(b, 0):
                cls, _ = _classes(h, owner, hi - lo)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(cls)), lists], names=["class", "shingles"])

    found = slotted.mapInArrow(listed, "class long, shingles array<long>")
    return shared.written(found.join(first.select("class"), "class").dropDuplicates(["class"]))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with `both`, the number of shingles in common, and `either`."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = joined.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes"))
    return shared.written(out.select("a", "b", "both", (F.col("sizes") - F.col("both")).alias("either")))


def _linked():
    return F.col("both") * DEN >= F.col("either") * NUM


def _fits(x: str, y: str):
    """Whether members x and y of a region (prefixes of n and place) can still be linked.

    A link needs an overlap of NUM / (NUM + DEN) of both sizes together.  If the
    region's shingle is the first that the two share, no more than what stands
    from its place on can be shared; a pair that is linked passes in the region
    of that first shingle.
    """
    need = (F.col(f"{x}n") + F.col(f"{y}n")) * NUM
    return ((F.col(f"{x}n") - F.col(f"{x}place")) * (NUM + DEN) >= need) & (
        (F.col(f"{y}n") - F.col(f"{y}place")) * (NUM + DEN) >= need
    )


def linked_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n_shingles) of the rows and the links (a, b, both, either) between classes.

    Rows need the columns doc_id, text and mark, a hash of the text.
    """
    bits = postings.bucket_bits(rows)
    docs, order = _counts(rows, bits)
    regions = _regions(rows, order, bits)
    # The pivot is the member that the region's shingle comes first in: it has the fewest shingles of its own.
    pivots = regions.groupBy("region").agg(F.min(F.struct("place", "class", "n")).alias("p"), F.min("n").alias("least"))
    pivots = pivots.select("region", "least", F.col("p.class").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.place").alias("pivot_place"))
    # A member that doesn't fit the smallest set of its region fits none.
    some = (F.col("n") - F.col("place")) * (NUM + DEN) >= (F.col("n") + F.col("least")) * NUM
    members = shared.written(regions.join(pivots, "region").where(some | (F.col("class") == F.col("pivot"))).drop("least"))
    shared.discard(regions)
    star = members.where((F.col("class") != F.col("pivot")) & _fits("", "pivot_"))
    star = shared.written(star.select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct())
    wanted = star.select(F.col("a").alias("class")).union(star.select("b")).distinct()
    sets = _sets(rows, wanted, docs)
    measured = _measured(star, sets)
    shared.discard(star, sets)
    near = components(measured.where(_linked()))

    away = measured.select(F.col("a").alias("pivot"), F.col("b").alias("class"), (1 - F.col("both") / F.col("either")).alias("distance"))
    # The pivot is at 0 from itself; a member that was ruled out was not measured and has no window.
    cells = members.join(away, ["pivot", "class"], "left")
    cells = cells.withColumn("distance", F.when(F.col("class") == F.col("pivot"), 0.0).otherwise(F.col("distance")))
    cells = _open(cells.select("region", "class", "n", "place", "distance", F.lit(False).alias("stuck")), near)
    shared.discard(members)
    while not cells.isEmpty():
        found, inner = _cut(cells, rows, docs)
        measured = measured.unionByName(found)
        near = components(measured.where(_linked()))
        last, cells = cells, _open(inner, near)
        shared.discard(last, inner)
    return docs, measured.where(_linked())


#: members outside the main component up to which a cell is compared directly, a block of such a cell, pivots of others
FEW, BLOCK, PIVOTS = 32, 256, 8
#: cells that a member goes to, on the average of its region, up to which the region is cut
COPIES = 1.5
RADIUS = 1 - NUM / DEN + 1e-9
#: columns of a member of a cell
CELL = ("region", "class", "n", "place", "distance", "stuck")


def _open(cells: DataFrame, near: DataFrame) -> DataFrame:
    """Members (CELL and component, main) of the cells that are not in one component yet, written."""
    label = near.select(F.col("node").alias("class"), "component")
    placed = cells.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    sizes = placed.groupBy("region", "component").agg(F.count("*").alias("members"))
    main = sizes.groupBy("region").agg(
        F.max(F.struct("members", "component")).alias("m"), F.count("*").alias("parts"), F.sum("members").alias("all")
    )
    main = main.where(F.col("parts") > 1)
    main = main.select("region", F.col("m.component").alias("main"), "all", (F.col("all") - F.col("m.members")).alias("outside"))
    return shared.written(placed.join(main, "region").select(*CELL, "component", "main", "all", "outside"))


def _cut(cells: DataFrame, rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is measured in open cells, and the cells (CELL) inside them that are left."""
    direct = F.col("stuck") | (F.col("outside") <= FEW)
    small, large = cells.where(direct), cells.where(~direct)
    # Pivots: of the members outside the main component those with the smallest hashes, each by another hash.
    chosen = [F.min_by("class", F.xxhash64("class", F.lit(i))) for i in range(PIVOTS)]
    pivots = large.where(F.col("component") != F.col("main")).groupBy("region").agg(F.array_distinct(F.array(*chosen)).alias("p"))
    pivots = pivots.select("region", F.explode("p").alias("pivot"))
    dealt = large.join(pivots, "region")
    ends = [F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")]
    pairs = shared.written(_direct(small).unionByName(dealt.where(F.col("class") != F.col("pivot")).select(*ends)).distinct())
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sets = _sets(rows, wanted, docs)
    found = _measured(pairs, sets)
    shared.discard(pairs, sets)
    # Pivots have met every member of their cell and are done; the others go to their nearest pivot and, near a border, to more.
    apart = found.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d"))
    others = dealt.select("region", "pivot", "class", "n", "place", "all", *ends)
    met = pivots.withColumnRenamed("pivot", "class")
    others = others.join(met, ["region", "class"], "left_anti").join(apart, ["a", "b"])
    others = others.groupBy("region", "class", "n", "place", "all").agg(F.sort_array(F.collect_list(F.struct("d", "pivot"))).alias("to"))
    others = shared.written(others.withColumn("near", F.filter("to", lambda t: t["d"] <= F.col("to")[0]["d"] + 2 * RADIUS)))
    cut = others.groupBy("region").agg((F.sum(F.size("near")) <= COPIES * F.count("*")).alias("cut"))
    others = others.join(cut, "region")
    parts = others.where("cut").withColumn("c", F.explode("near")).select(F.xxhash64("region", "c.pivot").alias("region"), "class", "n", "place", F.col("c.d").alias("distance"), "all")
    left = parts.groupBy("region").agg(F.count("*").alias("left"))
    parts = parts.join(left, "region").withColumn("stuck", F.col("left") > 0.5 * F.col("all"))
    # All members of a region that stays whole have met the same pivots: the first of those takes the place of its own.
    one = F.array_min(F.transform("to", lambda t: F.struct(t["pivot"].alias("pivot"), t["d"].alias("d"))))["d"]
    whole = others.where(~F.col("cut")).withColumns({"distance": one, "stuck": F.lit(True)})
    inner = shared.written(parts.select(*CELL).unionByName(whole.select(*CELL)))
    shared.discard(others)
    return found, inner


def _direct(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within cells that the windows let through.

    One end lies outside the main component.  Both sides of a cell are dealt in blocks of about BLOCK
    members, so that a task gets no more of either at once.
    """
    names = ("class", "n", "place", "component", "main", "distance")
    sides = []
    for side, own, size, other, count in (("x_", "i", "outside", "j", "all"), ("y_", "j", "all", "i", "outside")):
        blocks, copies = (F.ceil(F.col(c) / BLOCK).cast("int") for c in (size, count))
        number = F.pmod(F.xxhash64("class"), blocks).cast("int").alias(own)
        dealt = cells.withColumn(other, F.explode(F.sequence(F.lit(0), copies - 1)))
        sides.append(dealt.select("region", number, other, *[F.col(c).alias(side + c) for c in names]))
    x, y = sides[0].where(F.col("x_component") != F.col("x_main")), sides[1]
    window = F.coalesce(F.abs(F.col("x_distance") - F.col("y_distance")) <= RADIUS, F.lit(True))
    apart = F.col("x_component") != F.col("y_component")
    once = (F.col("y_component") == F.col("y_main")) | (F.col("x_class") < F.col("y_class"))
    met = x.join(y, ["region", "i", "j"]).where(apart & once & window & _fits("x_", "y_"))
    return met.select(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts have no shingles and are linked with nothing: their
    component is their own doc_id.  Rows with a null doc_id link like any other;
    their component is the smallest id of their group, or null where it has none.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    found, links = linked_classes(rows)
    label = components(links).select(F.col("node").alias("class"), "component")
    least = found.where(F.col("n_shingles") > 0).groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = shared.written(named)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "component").select("class", "component_id")
    out = found.join(by_class, "class", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near copies: that of the smallest doc_id.  Columns unchanged.

    Rows with a null doc_id stay.  Of rows with the same doc_id all stay or go.
    """
    kept = groups(docs).where(F.col("doc_id") != F.col("component_id"))
    gone = kept.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
