"""Whitening of embeddings: principal components by cyclic Jacobi rotations, scaled to unit variance.

Vectors are taken to whole numbers, so their count and sums are exact. A second pass
sums the products of centred values over all rows, a matrix of the vectors' dimension. The
driver turns pairs of its axes until no off-diagonal entry is left. Each rotation
is stopped by a bound relative to its two diagonal entries, which keeps small
eigenvalues accurate. The sorted components are broadcast and applied to every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vector's entry c becomes floor(STEPS c) + ORIGIN.
STEPS, ORIGIN = 64, 1_000_000
COMPONENTS = 32
#: Rounds over all pairs of axes; some eight are enough.
SWEEPS = 40
#: Entries beyond this are not exact as whole numbers.
_MOST = 2.0**52 / STEPS
_EPS = 2.0**-52


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    floor = _EPS * _EPS * abs(np.trace(a))
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= floor or abs(off) <= _EPS * math.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                t = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1 / (abs(t) + math.hypot(1, t)), t)
                c = 1 / math.hypot(1, t)
                turn = np.array([[c, -t * c], [t * c, c]])
                a[p, p] -= t * off
                a[q, q] += t * off
                a[p, q] = a[q, p] = 0.0
                others = np.ones(d, bool)
                others[[p, q]] = False
                rows = turn @ a[[p, q]][:, others]
                a[np.ix_([p, q], others)] = rows
                a[np.ix_(others, [p, q])] = rows.T
                v[:, [p, q]] = v[:, [p, q]] @ turn.T
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass
class Whitening:
    """``n`` vectors with exact sums of their whole numbers, eigenvalues and components (columns) of the covariance, and its trace."""

    n: int
    sums: np.ndarray
    #: A bound on the deviation of a vector.
    most: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def there(self) -> np.ndarray:
        """Which components have a variance at all, beyond rounding."""
        return self.values > len(self.values) * 4 * _EPS * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times each whole number less their sum: exact, and zero in sum."""
        return self.n * x - self.sums

    def deviations(self, y: np.ndarray) -> list[int]:
        if self.most < 1 << 63:
            return (y * y).sum(1).tolist()
        return [sum(v * v for v in row) for row in y.tolist()]

    def whitened(self, y: np.ndarray, components: int) -> np.ndarray:
        there = self.there[:components]
        scale = np.where(there, 1 / np.sqrt(np.where(there, self.values[:components], 1.0)), 0.0)
        return (y / self.n) @ self.vectors[:, :components] * scale

    def explained(self, components: int) -> list[float]:
        return [max(0.0, float(e)) / self.trace if there else 0.0 for e, there in zip(self.values[:components], self.there[:components], strict=True)]


def usable(vector: Column) -> Column:
    """Vectors without null, NaN and infinite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def whole(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of whole numbers."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors have {lengths.min()} to {lengths.max()} dimensions")
    if len(flat) and np.abs(flat).max() > _MOST:
        raise ValueError(f"an entry of a vector is beyond {_MOST:.0f}")
    return (np.floor(flat * STEPS).astype(np.int64) + ORIGIN).reshape(n, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, low, high = 0, None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        x = whole(b.column("x"))
        n += len(x)
        if total is None:
            total, low, high = x.sum(0), x.min(0), x.max(0)
        elif len(total) != x.shape[1]:
            raise ValueError(f"vectors have {len(total)} and {x.shape[1]} dimensions")
        else:
            total, low, high = total + x.sum(0), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    d = 0 if total is None else len(total)
    # Dimension -1 stands for the row count, so that vectors of no dimension count too.
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([n] * (d + 1), pa.int64()), *(pa.array([0, *([] if x is None else x.tolist())], pa.int64()) for x in (total, low, high))], ["i", "n", "total", "low", "high"])


def _scatter(rows):
    """Sums of products of each task's rows, the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = rows(whole(b.column("x")))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    return run


def _covariance(x: DataFrame, rows, n: int, d: int) -> np.ndarray:
    """d * d numbers reach the driver, however many rows there are."""
    out = np.zeros((d, d))
    for r in x.mapInArrow(_scatter(rows), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / n
    return out


def _vectors(df: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    return df.where(usable(v)).select(v.cast("array<double>").alias("x"))


def fit(df: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Exact sums, then the centred scatter, then rotations on the driver; None where no vector is usable.

    Rows whose vector is null or has a null or non-finite entry are left out,
    repeated ones count. Vectors of several dimensions are an error, and so is
    an entry beyond 2^46.
    """
    x = _vectors(df, vector_col)
    found = {r["i"]: r for r in x.mapInArrow(_sums, "i int, n long, total long, low long, high long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min(F.when(F.col("n") > 0, F.col("low"))).alias("low"), F.max(F.when(F.col("n") > 0, F.col("high"))).alias("high")).collect()}
    n, d = int(found[-1]["n"] or 0) if found else 0, len(found) - 1
    if n == 0:
        return None
    if any(found[i]["n"] != n for i in range(d)):
        raise ValueError("vectors have several dimensions")
    sums = [int(found[i]["total"]) for i in range(d)]
    far = [max(abs(n * int(found[i][k]) - sums[i]) for k in ("low", "high")) for i in range(d)]
    if max([0, *(abs(s) for s in sums), *(n * abs(int(found[i][k])) for i in range(d) for k in ("low", "high"))]) >= 1 << 63:
        raise OverflowError("sums of vectors do not fit 64 bits")
    out = Whitening(n, np.array(sums, np.int64), sum(f * f for f in far), np.zeros(d), np.eye(d), 0.0)
    matrix = _covariance(x, lambda x: out.centred(x) / n, n, d)
    out.values, out.vectors = jacobi(matrix)
    out.trace = float(np.trace(matrix))
    return out


def identity_error(df: DataFrame, model: Whitening | None, vector_col: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, over components with a variance.

    Centred whole numbers sum to zero exactly, so whitened rows are centred.
    """
    if model is None:
        return 0.0
    k = min(components, len(model.values))
    send = df.sparkSession.sparkContext.broadcast(model)
    got = _covariance(_vectors(df, vector_col), lambda x: send.value.whitened(send.value.centred(x), k), model.n, k)
    there = model.there[:k]
    return float(np.abs(got - np.eye(k))[np.ix_(there, there)].max(initial=0.0))


def _apply(send, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        for b in batches:
            y = model.centred(whole(b.column("x")).reshape(b.num_rows, len(model.sums)))
            deviations = model.deviations(y)
            if max(deviations, default=0) >= 1 << 63:
                raise OverflowError("a deviation does not fit 64 bits")
            z = model.whitened(y, k)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(deviations, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))], ["row", "deviation", "whitened"])

    return run


def whitened(df: DataFrame, model: Whitening | None, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows of ``df`` with a usable vector, with ``deviation`` (long, exact) and ``whitened`` (array of double) behind its columns.

    Repeated rows are whitened alike. A component without a variance is 0 for all
    rows (fewer vectors than dimensions, constant entries). No usable vector, or an empty table:
    no rows. Columns of ``df`` named ``deviation`` or ``whitened`` are replaced.
    """
    df = df.drop(*[c for c in ("deviation", "whitened") if c != vector_col])
    v = F.col(f"`{vector_col}`")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    slim = df.where(usable(v)).select(row.alias("row"), v.cast("array<double>").alias("x"))
    if model is None:
        out = slim.where(F.lit(False)).select("row", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    else:
        send = df.sparkSession.sparkContext.broadcast(model)
        out = slim.mapInArrow(_apply(send, min(components, len(model.values))), f"row {slim.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)], "deviation", "whitened")


def components_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component, with what the component explains and how far the result is from white."""
    df = df.select(id_col, vector_col)
    model = fit(df, vector_col)
    error = identity_error(df, model, vector_col, components)
    explained = model.explained(components) if model else []
    long = whitened(df, model, vector_col, components).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.lit(np.array(explained, np.float64)) if explained else F.array().cast("array<double>")
    return long.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
