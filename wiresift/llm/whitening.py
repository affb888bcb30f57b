"""Embedding whitening: principal components of all vectors by a tiled covariance.

Vectors are cut into column blocks, which are shuffled by row-block; a task multiplies
the pairs of column blocks of a row-block and sums the products by tile, the pairs of
blocks of dimensions; tiles are summed over all tasks in two steps.  The driver sees
one number for each pair of dimensions, never a vector.  Entries are centred before
they are multiplied.

Vectors that are null, empty, or hold null or non-finite entries are left out, and so
are those of another length than most have (of equally frequent lengths the longest
counts).  Repeated and null ids are rows of their own.  An entry beyond 2^43 counts
as 2^43.  Components whose eigenvalue is zero to double precision don't exist: equal
vectors, or a single one, have none, and give no rows, as does an empty table.
Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Dimensions of a column block, and vectors of a row-block.
TILE, ROWS = 32, 512
#: Groups in which a tile's sums are added up first.
GROUPS = 64
#: Bytes of sums after which a task hands them on.
HELD = 64 << 20
#: Largest entry, and 38 digits, the widest number of a table.
MOST, DIGITS = float(1 << 43), 10**38


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).where((F.size("v") > 0) & ~bad)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (top[0]["d"] if top else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.floor(1024 * np.clip(v, -MOST, MOST)).astype(np.int64) + 100_000


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, however large: high and low parts are summed apart."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(a) << 26) + int(b) for a, b in zip(high.sum(0), low.sum(0))]


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension's entries."""

    def add(batches):
        n, sums = 0, None
        for b in batches:
            if len(b):
                part = exact_sums(scaled(matrix(b.column("v"))))
                n, sums = n + len(b), part if sums is None else [s + p for s, p in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(len(sums)), pa.int32()), "s": pa.array(map(Decimal, sums), pa.decimal128(38, 0)), "n": pa.array([n] * len(sums), pa.int64())}
            )

    found = rows.select("v").mapInArrow(add, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - sums exactly: machine integers where they reach, else Python's."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> pa.Array:
    """Sum of the squares of each row, exactly; null where it is wider than a number of a table."""
    kind = pa.decimal128(38, 0)
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
        return pa.array((y * y).sum(1)).cast(kind)
    wide = (y.astype(object) ** 2).sum(1)
    return pa.array([Decimal(int(s)) if s < DIGITS else None for s in wide], kind)


def covariance(rows: DataFrame, d: int, n: int, centred: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> np.ndarray:
    """Covariance, divisor n, of `rows` (v) with d entries; `centred` takes the mean from a matrix of them."""
    width, cuts = shared.shuffle_width(rows.sparkSession), range(0, d, tile)

    def cut(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, len(b), ROWS):
                z = centred(matrix(b.column("v").slice(at, ROWS)))
                blocks = [np.ascontiguousarray(z[:, c : c + tile]).tobytes() for c in cuts]
                yield pa.RecordBatch.from_pydict(
                    {"row_block": pa.array([number] * len(blocks), pa.int64()), "col_block": pa.array(range(len(blocks)), pa.int32()), "z": pa.array(blocks, pa.binary())}
                )
                number += 1

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        group, sums, blocks, now = TaskContext.get().partitionId() % GROUPS, {}, [], None

        def add() -> None:
            for i, a in enumerate(blocks):
                for j in range(i, len(blocks)):
                    product = a.T @ blocks[j]
                    sums[i, j] = sums[i, j] + product if (i, j) in sums else product

        for b in batches:
            for row_block, z in zip(b.column("row_block").to_pylist(), b.column("z")):
                if row_block != now:
                    add()
                    now, blocks = row_block, []
                    if sum(s.nbytes for s in sums.values()) > HELD:
                        yield tiles(sums, group)
                        sums.clear()
                wide = min(tile, d - tile * len(blocks))
                blocks.append(np.frombuffer(z.as_buffer(), np.float64).reshape(-1, wide))
        add()
        if sums:
            yield tiles(sums, group)

    def add_up(batches) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for i, j, raw in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("s")):
                part = np.frombuffer(raw.as_buffer(), np.float64)
                if (i, j) == now:
                    total = total + part
                    continue
                if now is not None:
                    yield tiles({now: total}, now[0] % GROUPS)
                now, total = (i, j), part
        if now is not None:
            yield tiles({now: total}, now[0] % GROUPS)

    kind = "i int, j int, part int, s binary"
    blocks = rows.select("v").mapInArrow(cut, "row_block long, col_block int, z binary").repartition(width, "row_block")
    sums = blocks.sortWithinPartitions("row_block", "col_block").mapInArrow(multiply, kind)
    for keys in (("i", "j", "part"), ("i", "j")):
        sums = sums.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(add_up, kind)
    out = np.zeros((d, d))
    for r in sums.toLocalIterator():
        a, b = r["i"] * tile, r["j"] * tile
        high, wide = min(tile, d - a), min(tile, d - b)
        block = np.frombuffer(r["s"], np.float64).reshape(high, wide)
        out[a : a + high, b : b + wide] = block
        out[b : b + wide, a : a + high] = block.T
    return out / n


def tiles(sums: dict, group: int) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_pydict(
        {
            "i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()),
            "part": pa.array([group] * len(keys), pa.int32()), "s": pa.array([sums[k].tobytes() for k in keys], pa.binary()),
        }
    )


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    if not len(v):
        return np.zeros(0), v
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > max(0.0, values[0]) * len(v) * np.finfo(float).eps).sum()))
    values, vectors = values[:k], vectors[:, :k]
    at = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[at, np.arange(k)] < 0, -1.0, 1.0)


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = 8) -> DataFrame:
    """Each vector's first `most` whitened coordinates (OUT), a row for each.

    `deviation` is the vector's squared distance from the mean, times n squared, exactly;
    null where that has more than 38 digits.
    """
    spark, rows = vectors.sparkSession, usable(vectors, vector)
    n, sums = totals(rows)
    d = len(sums)
    total = covariance(rows, d, n, lambda v: (deviations(scaled(v), n, sums) / n).astype(np.float64)) if n else np.zeros((0, 0))
    values, axes = components(total, most)
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], OUT)
    turned = axes / np.sqrt(values)

    def project(batches):
        for b in batches:
            if len(b):
                y = deviations(scaled(matrix(b.column("v"))), n, sums)
                w = (y / n).astype(np.float64) @ turned
                lists = pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), squares(y), lists], names=["vec_id", "deviation", "v"])

    done = shared.written(rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), v array<double>"))
    mean = np.array(done.agg(*[F.sum(F.get("v", F.lit(i))) for i in range(k)]).first()) / n
    error = float(np.abs(covariance(done, k, n, lambda w: w - mean) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e)) for e in values / np.trace(total)])
    rows = done.select("vec_id", "deviation", F.posexplode("v").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
