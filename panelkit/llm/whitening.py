"""Embedding whitening by a bidiagonal qd solver (operator 11).

1. Vectors become whole numbers, floor(256 * c); the fit list is each distinct one once (a combined distinct, so copies cost
   nothing). Its sums are exact: halves of 32 bits are added in tasks and decimals in Spark.
2. Every task centres its rows and keeps one triangle, by QR of the triangle so far and the next block; triangles are
   stacked and factorised again, FAN at a time, until one is left. No product of the matrix with itself is formed.
3. That d x d triangle is made bidiagonal by Householder reflections; dqds finds its singular values, twisted
   factorisations the directions (bidiagonal.py).
4. A second pass over the fit list measures how far the whitened rows' covariance is from the identity; a pass over all
   rows projects them.

Defined results: a vector takes part if it is not null, holds no null or non-finite entry and has the commonest length
(ties: the longer one) among such vectors; other rows are dropped, as are empty vectors. Entries beyond what a long
holds count as the nearest long. Repeated rows and null vec_ids are each projected. A component whose eigenvalue is 0
but for rounding (no spread left; one distinct vector) has whitened null and, where nothing varies at all, explained
null; it takes no part in identity_error, which is null if no component has any spread. deviation is null where it
exceeds a long. With fewer dimensions than components asked for, there are as many as dimensions. An empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import EPS, right_singular
from .common import cut, discard

SCALE = 256
#: Triangles that one task stacks.
FAN = 32
#: Rows factorised at once.
ROWS = 4096
_MOST = 2**63 - 1


class Whitening:
    """A fitted model: n, sums (exact), mean, directions (d x k columns), deviations (k standard deviations, 0: none), explained, trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, components: int) -> None:
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])
        variance = values / n
        self.trace = float(variance.sum())
        kept = min(components, len(sums))
        flat = np.sqrt(variance[:kept]) <= len(sums) * EPS * max(1.0, float(np.sqrt(variance[0]) if kept else 0), float(np.abs(self.mean).max()))
        self.deviations = np.where(flat, 0.0, np.sqrt(variance[:kept]))
        self.directions = vectors[:, :kept]
        share = [float(v) / self.trace if s > 0 else 0.0 for v, s in zip(variance[:kept], self.deviations)] if not flat.all() else []
        self.explained: list[float | None] = share or [None] * kept

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without spread."""
        out = (x.astype(np.float64) - self.mean) @ self.directions
        return np.divide(out, self.deviations, out=np.full_like(out, np.nan), where=self.deviations > 0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, exact."""
        reach = self.n * max(int(x.max()), -int(x.min()), 0) + max(map(abs, self.sums)) if x.size else 0
        if reach * reach * x.shape[1] <= _MOST:
            gap = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v <= _MOST else None for v in exact]


def _whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): which rows take part, and their whole numbers (rows x dims, int64)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    fits = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(fits)).flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat).reshape(len(fits), dims)
    good = np.isfinite(values).all(axis=1)
    low, high = -float(2**63), np.nextafter(2.0**63, 0)
    return fits[good], np.clip(np.floor(values[good] * SCALE), low, high).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes an entry: equal rows give equal bytes."""
    reach = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if len(x) else np.empty(0)
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in (("<i2", 0, 2**15), ("<i4", 2**15, 2**31), ("<i8", 2**31, 2**64)):
        rows = np.flatnonzero((reach >= low) & (reach < high if high < 2**63 else True))
        body = x[rows].astype(kind).tobytes()
        width = int(kind[2]) * x.shape[1]
        for k, i in enumerate(rows.tolist()):
            out[i] = body[k * width : (k + 1) * width]
    return out


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of bytes -> whole numbers (the rows' order does not matter)."""
    values = column.to_pylist()
    groups = [[v for v in values if len(v) == width * dims] for width in (2, 4, 8)]
    return np.concatenate([np.frombuffer(b"".join(g), dtype=f"<i{w}").reshape(-1, dims).astype(np.int64) for g, w in zip(groups, (2, 4, 8))])


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            yield _unpacked(batch.column(0).slice(begin, ROWS), dims)


def _keys(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_packed(_whole(batch.column(0), dims)[1]), pa.binary())], ["x"])


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, [0] * dims
    for x in _blocks(batches, dims):
        n += len(x)
        high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
        total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
    if n:
        place = pa.array(range(dims), pa.int32())
        yield pa.RecordBatch.from_arrays([place, pa.array([n] * dims, pa.int64()), pa.array([str(t) for t in total])], ["dim", "n", "total"])


def _triangle(held: list[np.ndarray], dims: int) -> bytes:
    out = np.zeros((dims, dims))
    r = np.linalg.qr(np.concatenate(held), mode="r")
    out[: len(r)] = r
    return out.tobytes()


def _factorised(batches: Iterator[pa.RecordBatch], dims: int, mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One triangle a task, from blocks of centred rows."""
    held = b""
    for x in _blocks(batches, dims):
        before = [np.frombuffer(held).reshape(dims, dims)] if held else []
        held = _triangle([*before, x.astype(np.float64) - mean], dims)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held], pa.binary())], ["at", "r"])


def _stacked(key: tuple[pa.Scalar, ...], rows: pa.Table, dims: int) -> pa.Table:
    parts = [np.frombuffer(r).reshape(dims, dims) for r in rows.column("r").to_pylist()]
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([_triangle(parts, dims)], pa.binary())})


def _moments(batches: Iterator[pa.RecordBatch], dims: int, model: Whitening) -> Iterator[pa.RecordBatch]:
    """Sums of whitened rows (j = -1) and of their products, as (i, j, total)."""
    used = np.flatnonzero(model.deviations > 0)
    one, two = np.zeros(len(used)), np.zeros((len(used), len(used)))
    for x in _blocks(batches, dims):
        y = model.project(x)[:, used]
        one += y.sum(axis=0)
        two += y.T @ y
    i, j = np.meshgrid(used, used, indexing="ij")
    columns = [np.concatenate([used, i.ravel()]), np.concatenate([np.full(len(used), -1), j.ravel()]), np.concatenate([one, two.ravel()])]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])], ["i", "j", "total"])


def dimensions(vectors: DataFrame) -> int:
    """The commonest length of the vectors that could take part, the longer one in ties; 0 if there is none."""
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    best = vectors.where(whole).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return int(best["d"]) if best else 0


def fit_list(vectors: DataFrame, dims: int) -> DataFrame:
    """Each distinct whole-number vector once, as bytes (column x)."""
    return cut(vectors.select("v").mapInArrow(lambda b: _keys(b, dims), "x binary").distinct())


def fit(listed: DataFrame, dims: int, components: int | None = None) -> Whitening:
    """The whitening of a fit list: all directions, or the first `components`."""
    totals = listed.mapInArrow(lambda b: _sums(b, dims), "dim int, n bigint, total string")
    exact = totals.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()  # one row a dimension
    n, sums = int(exact[0]["n"]), [int(r["total"]) for r in exact]
    mean = np.array([s / n for s in sums])
    triangles = cut(listed.mapInArrow(lambda b: _factorised(b, dims, mean), "at bigint, r binary"))
    widest, level = triangles.agg(F.max("at")).first()[0], triangles
    while widest > 0:
        level = level.groupBy(F.floor(F.col("at") / FAN).alias("up")).applyInArrow(lambda k, t: _stacked(k, t, dims), "at bigint, r binary")
        widest //= FAN
    r = np.frombuffer(level.first()["r"]).reshape(dims, dims)  # dims squared, whatever the number of rows
    discard(triangles)
    values, vectors = right_singular(r)
    return Whitening(n, sums, values, vectors, components or dims)


def identity_error(listed: DataFrame, dims: int, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    rows = listed.mapInArrow(lambda b: _moments(b, dims, model), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect()  # components squared
    total = {(r[0], r[1]): r[2] / model.n for r in rows}
    gaps = [abs(v - total[i, -1] * total[j, -1] - (i == j)) for (i, j), v in total.items() if j >= 0]
    return max(gaps) if gaps else None


def _projected(batches: Iterator[pa.RecordBatch], dims: int, model: Whitening, error: float | None) -> Iterator[pa.RecordBatch]:
    k = len(model.deviations)
    for batch in batches:
        rows, x = _whole(batch.column(1), dims)
        white = model.project(x).ravel()
        times = np.repeat(np.arange(len(rows)), k)
        columns = [
            batch.column(0).take(pa.array(rows[times])),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
            pa.array(np.full(len(times), model.n)),
            pa.array(model.deviation(x), pa.int64()).take(pa.array(times)),
            pa.array(white, mask=np.isnan(white)),
            pa.array(model.explained * len(rows), pa.float64()),
            pa.array([error] * len(times), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(table: DataFrame, components: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per row that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(table.dtypes)[key]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = table.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    dims = dimensions(vectors)
    if not dims:
        return table.sparkSession.createDataFrame([], schema)
    listed = fit_list(vectors, dims)
    model = fit(listed, dims, components)
    error = identity_error(listed, dims, model)
    discard(listed)
    return vectors.mapInArrow(lambda b: _projected(b, dims, model, error), schema)
