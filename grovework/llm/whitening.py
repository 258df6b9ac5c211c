"""Whitening of embeddings by a bidiagonal qd solver.

Rows are whole numbers x. One pass gives their number n and exact sums S; a
second reduces the centred rows by blockwise QR, each task to one triangle R,
and triangles to one in a tree of `FAN` at a time. R'R is n times the
covariance, but is never formed: R goes through Householder bidiagonalisation,
dqds and twisted factorisations (`qd.py`), so small components keep their
accuracy. A third pass measures the covariance of the whitened rows, a fourth
returns them. No pass moves rows between tasks; the driver sees one matrix of
the order of a vector's length.

Edge cases: rows whose vector is null, or has a null or non-finite entry or one
beyond 2^34 in size, take no part, and neither do rows whose vector has another
length than most of them (of equally frequent lengths the longest counts); null
ids and repeated rows stay. Components whose standard deviation is below 1e-12
of the first's have no direction and are left out, so equal rows, or a single
one, give an empty result, and so do an empty table and vectors of length
zero. Other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import slices, written
from grovework.llm.qd import principal

FAN = 64


def usable(vector: Column, limit: float = 2.0**34) -> Column:
    """Whether a vector is complete and finite."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows of the most frequent vector length, and that length."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size(vector) == sizes.d), sizes.d) if sizes else (rows, 0)


def matrix(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def sums(rows: DataFrame, vector: str, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, 0, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([len(x), *x.sum(axis=0).tolist()], pa.int64())], names=["dim", "s"])

    found = rows.select(vector).mapInArrow(run, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = {r.dim: int(r.s) for r in found.collect()}  # one row for each dimension
    return total.get(-1, 0), [total.get(k, 0) for k in range(size)]


class Centre:
    """x - S / n: as doubles, and times n exactly."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.whole, self.rest = n, np.array([s // n for s in total], np.int64), [s % n for s in total]

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array(self.rest, float) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2."""
        off = x - self.whole
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < int((2**63 / max(1, x.shape[1])) ** 0.5):
            return pa.array(((self.n * off - np.array(self.rest, np.int64)) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        exact = [sum((self.n * o - r) ** 2 for o, r in zip(row, self.rest)) for row in off.tolist()]
        return pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0))


def in_tree(rows: DataFrame, columns: list[str], of_task: Callable[[Iterator[pa.RecordBatch]], bytes | None], merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value of each task, merged FAN at a time in written rounds; the driver
    merges the last few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (value := of_task(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())], names=["part", "value"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table({"part": [table["part"][0].as_py() // FAN], "value": pa.array([merge(table["value"].to_pylist())], pa.binary())})

    parts = written(rows.select(*columns).mapInArrow(run, "part long, value binary"), "parts")
    while parts.count() > FAN:
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(joined, "part long, value binary"), "parts")
    values = [r.value for r in parts.orderBy("part").collect()]
    return merge([bytes(v) for v in values]) if values else None


def triangle(rows: DataFrame, vector: str, size: int, centre: Centre) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""

    def reduced(blocks: Iterator[np.ndarray]) -> bytes:
        held = np.zeros((size, size))
        for block in blocks:
            held = np.linalg.qr(np.vstack([held, block]), mode="r")
        return held.tobytes()

    def of_task(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        return reduced(centre.doubles(matrix(batch, 0, size)) for batch in slices(batches, 4096))

    found = in_tree(rows, [vector], of_task, lambda parts: reduced(np.frombuffer(p).reshape(size, size) for p in parts))
    return np.frombuffer(found).reshape(size, size) if found else np.zeros((size, size))


def covariance(rows: DataFrame, vector: str, size: int, made: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Covariance, divisor n, of `made` (blocks of rows to blocks of `width`
    columns), from blocks that are centred before they are multiplied."""

    def merged(parts: Iterator[np.ndarray]) -> bytes:
        n, mean, inner = 0.0, np.zeros(width), np.zeros((width, width))
        for part in parts:
            k, own, more = part[0], part[1 : width + 1], part[width + 1 :].reshape(width, width)
            apart = own - mean
            inner = inner + more + np.outer(apart, apart) * (n * k / max(1.0, n + k))
            mean, n = mean + apart * (k / max(1.0, n + k)), n + k
        return np.concatenate(([n], mean, inner.ravel())).tobytes()

    def block(y: np.ndarray) -> np.ndarray:
        mean = y.mean(axis=0) if len(y) else np.zeros(width)
        return np.concatenate(([float(len(y))], mean, ((y - mean).T @ (y - mean)).ravel()))

    def of_task(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        return merged(block(made(matrix(batch, 0, size))) for batch in slices(batches, 4096))

    found = np.frombuffer(in_tree(rows, [vector], of_task, lambda parts: merged(np.frombuffer(p) for p in parts)))
    return found[width + 1 :].reshape(width, width) / found[0]


def whitened(rows: DataFrame, id_col: str, vector: str, components: int = 32) -> DataFrame:
    """id_col, component (from 1), n, deviation (decimal), whitened, explained
    and identity_error: a row for each row of `rows` and component. `vector`
    holds whole numbers, none of them null."""
    rows, size = of_one_length(rows, vector)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, total = sums(rows, vector, size) if size else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    centre = Centre(n, total)
    squares, directions = principal(r := triangle(rows, vector, size, centre), components)
    found = len(squares)
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    explained = squares / float((r * r).sum())
    scaled = directions / np.sqrt(squares / n)
    white = lambda x: centre.doubles(x) @ scaled
    error = float(np.abs(covariance(rows, vector, size, white, found) - np.eye(found)).max())
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            x = matrix(batch, 1, size)
            at = pa.array(np.repeat(np.arange(len(x)), found))
            long = len(x) * found
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(long, n, np.int64)),
                    centre.deviation(x).take(at),
                    pa.array(white(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(long, error)),
                ],
                names=names,
            )

    return rows.select(id_col, vector).mapInArrow(run, schema)
