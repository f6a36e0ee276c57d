"""Whitening of embeddings by a compensated covariance: error-free products and sums in double-double arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Cells of a covariance in one row of a task's partial result, and groups that the tasks' results are first merged in.
CELLS, FAN = 4_096, 64
#: Products (rows times cells) that are formed at once.
PRODUCTS = 1 << 17
#: Components under this share of the greatest eigenvalue are rounding, not variance.
LEAST_SHARE = 1e-12
#: Scaled entries beyond this bound saturate there.
MOST = float(1 << 52)
_SPLIT = float((1 << 27) + 1)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A double as two halves whose products are exact."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and its exact error."""
    p, (ah, al), (bh, bl) = a * b, split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles, both parts compensated."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_ratio(a: int, b: int) -> tuple[float, float]:
    """The quotient of two integers as a double-double."""
    high = a / b
    top, bottom = high.as_integer_ratio()
    return high, (a * bottom - top * b) / (b * bottom)


class Products:
    """The sum of outer products of rows, upper triangle, in double-double."""

    def __init__(self, dims: int) -> None:
        self.i, self.j = np.triu_indices(dims)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))
        self.rows = max(1, PRODUCTS // max(1, len(self.i)))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Rows given as double-doubles; products of a block are summed as a tree."""
        i, j = self.i, self.j
        for at in range(0, len(high), self.rows):
            h, w = high[at : at + self.rows], low[at : at + self.rows]
            p, e = two_product(h[:, i], h[:, j])
            e = e + (h[:, i] * w[:, j] + w[:, i] * h[:, j])
            while len(p) > 1:
                half = len(p) // 2
                odd = (p[2 * half :], e[2 * half :])
                p, e = dd_add(p[:half], e[:half], p[half : 2 * half], e[half : 2 * half])
                if len(odd[0]):
                    p, e = np.concatenate([p, odd[0]]), np.concatenate([e, odd[1]])
            self.high, self.low = dd_add(self.high, self.low, p[0], e[0])


def _merge(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    high = low = None
    for b in batches:
        for h, w in zip(b.column("high"), b.column("low"), strict=True):
            h, w = h.values.to_numpy(), w.values.to_numpy()
            high, low = (h, w) if high is None else dd_add(high, low, h, w)
    return None if high is None else (high, low)


def _merge_part(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (m := _merge(batches)) is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([m[0]]), pa.array([m[1]])], ["chunk", "high", "low"])


def outer_sum(vectors: DataFrame, dims: int, centred) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of outer products, as full matrices; vectors (x array<long>), centred gives a batch's rows as double-doubles.

    A task hands on its triangle, in rows of CELLS cells; the tasks' triangles are merged in
    FAN groups and these once more, all in double-double. What reaches the driver is one
    triangle, bounded by the dimension.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, total, seen = dims, None, False
        for b in batches:
            high, low = centred(_rows(b.column("x"), width))
            total = total or Products(high.shape[1])
            total.add(high, low)
            seen = seen or len(high) > 0
        if seen:
            n, part = len(total.high), TaskContext.get().partitionId() % FAN
            at = range(0, n, CELLS)
            cells = [pa.array([x[i : i + CELLS] for i in at], pa.list_(pa.float64())) for x in (total.high, total.low)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(range(len(at)), pa.int32()), *cells], ["part", "chunk", "high", "low"])

    kind = "chunk int, high array<double>, low array<double>"

    def first(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge_part(key, batches)

    parts = vectors.select("x").mapInArrow(partial, f"part int, {kind}")
    once = parts.groupBy("chunk", "part").applyInArrow(first, kind)
    found = sorted(once.groupBy("chunk").applyInArrow(first, kind).collect(), key=lambda r: r["chunk"])
    cells = sum(len(r["high"]) for r in found)
    size = int((np.sqrt(8 * cells + 1) - 1) / 2)
    out = []
    for c in ("high", "low"):
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = [x for r in found for x in r[c]]
        out.append(full + np.triu(full, 1).T)
    return out[0], out[1]


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class Whitening:
    """n rows, exact sums a dimension, means as double-doubles, eigenvalues by size, unit eigenvectors in columns, the trace."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    mean_low: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x minus the mean, in double-double."""
        high, error = two_sum(x.astype(np.float64), -self.mean)
        return two_sum(high, error - self.mean_low)

    def project(self, x: np.ndarray, most: int) -> np.ndarray:
        """Centred rows on the first components, over the roots of their eigenvalues; NaN where a component has no variance."""
        high, low = self.centred(x)
        scale = np.where(self.real, np.sqrt(np.maximum(self.values, 0)), np.nan)[:most]
        return ((high + low) @ self.axes[:, :most]) / scale

    @property
    def real(self) -> np.ndarray:
        return self.values > LEAST_SHARE * max(float(self.values[0]), 0.0)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - sum)^2 over a row's dimensions; None where it leaves 64 bits."""
        if self.n * (float(np.abs(x).max(initial=1)) + max(abs(s) for s in self.sums) / self.n) < 2.0**62:
            d = self.n * x - np.array(self.sums, np.int64)
            if float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
                return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(r, self.sums, strict=True)) for r in x]
        return [v if v < 1 << 63 else None for v in exact]


def finite(vector: Column) -> Column:
    """Whether a vector is there and has only finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))


def fixed_point(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of every entry, as long; scaled entries beyond 2^52 saturate."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))).cast("long") + F.lit(shift).cast("long"))


def fit_whitening(vectors: DataFrame) -> Whitening | None:
    """Means, covariance (divisor n) and its eigenvectors of vectors (x array<long>); None where no vector has an entry.

    Sums are exact, as decimals. Outer products of centred rows are accumulated in
    double-double, so neither a great mean nor the order of tasks costs digits. The rounded
    covariance is brought to tridiagonal form and solved by divide and conquer (LAPACK's
    syevd, which numpy's eigh calls). Each eigenvector's greatest entry is positive.
    The most frequent dimension, of ties the greatest, is fitted; vectors of others are left out.
    """
    sums = vectors.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = cut(sums)
    first = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return None
    dims, n = first["d"], first["n"]
    total = [int(r["s"]) for r in sums.where(F.col("d") == dims).orderBy("i").collect()]
    mean = np.array([dd_ratio(s, n) for s in total])
    blank = Whitening(n, tuple(total), mean[:, 0].copy(), mean[:, 1].copy(), np.zeros(0), np.zeros((0, 0)), 0.0)
    high, low = outer_sum(vectors.where(F.size("x") == dims), dims, blank.centred)
    top = high / n
    p, e = two_product(top, np.full_like(top, float(n)))
    cov = top + ((high - p) - e + low) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(dims)])
    return Whitening(n, blank.sums, blank.mean, blank.mean_low, values, axes, float(np.trace(cov)))


def identity_error(vectors: DataFrame, model: Whitening, most: int) -> float | None:
    """The greatest absolute entry of the whitened vectors' covariance minus the identity, over components that have variance."""
    k = int(model.real[:most].sum())
    if not k:
        return None
    dims = len(model.sums)

    def whitened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = model.project(x, k)
        return w, np.zeros_like(w)

    high, low = outer_sum(vectors.where(F.size("x") == dims), dims, whitened)
    return float(np.abs((high + low) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): every vector on the first components of all of them.

    Vectors that are null or hold null or non-finite entries are left out of the fit and
    the result, as are empty ones and those of another than the most frequent dimension.
    Null and repeated ids and repeated vectors are rows like any other. A component
    without variance (equal rows, fewer rows than dimensions) has a null whitened; of equal
    eigenvalues any basis may come. A deviation that leaves 64 bits is null. An empty table
    gives no rows. Columns but the two are ignored, whatever their names.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.where(finite(F.col(vec_col))).select(F.col(id_col).alias("id"), fixed_point(F.col(vec_col), scale, shift).alias("x"))
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = len(model.sums)
    k, error = min(most, dims), identity_error(rows, model, most)
    share = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column("x"), dims)
            r = len(x)
            w = model.project(x, k).ravel()
            each = pa.array(np.repeat(np.arange(r), k))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(each),
                 pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, r)), pa.array([error] * (r * k), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == dims).mapInArrow(run, schema).withColumnRenamed("id", id_col)
