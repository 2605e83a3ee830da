"""Whitening of embeddings: exact integer covariance, float32 eigenvectors corrected by Ogita-Aishima iterations.

1.  Entries become integers x = floor(64 c) + OFFSET.  Tasks add up counts and sums; what goes to the driver are d sums.
2.  Tasks centre x by a whole number near its mean before multiplying and add up products, exactly; the driver gets one number for
    each pair of dimensions.  Sums of integers do not depend on the order, so a task that is run again changes nothing.
3.  Eigenvectors of the d x d covariance are found in float32 and corrected by products in extended precision (Ogita and
    Aishima: with R = I - X'X and S = X'AX, X becomes X + XE).  Where eigenvalues lie too close for a division, the block of
    X'AX of such a cluster, less its mean, is solved by itself and X is turned accordingly; then the iterations go on.
4.  Rows are projected; a pass before that adds up the whitened products for the error that every row carries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
ROWS = 2048  # rows that are multiplied at a time
EXACT = 1 << 20  # ROWS products of integers up to this are exact in a double
FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """Of all vectors: their number, their sums by dimension; eigenvalues (falling) and unit eigenvectors (columns) of the covariance of x, and its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def vectors_of(batch: pa.RecordBatch, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows hold a vector of ``dims`` finite entries, those vectors as x); with None all rows have one length."""
    lists = column(batch, "embedding")
    size = np.array([-1 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
    dims = dims if dims is not None else int(size.max(initial=0))
    rows = np.flatnonzero(size == dims)
    flat = pa.compute.fill_null(lists.take(pa.array(rows)).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    fine = np.isfinite(flat).all(1)
    flat = np.floor(SCALE * flat[fine])
    near = np.abs(flat) < 2.0**61
    x = np.where(near, flat, 0).astype(np.int64) + OFFSET
    return rows[fine], np.where(near, x, np.where(flat > 0, 1 << 61, -(1 << 61)))


def remaining(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that are not dropped."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def _summed(rows: DataFrame, per_task) -> list:
    """Exact sums of (i, j, v) over all tasks; v is a decimal of up to 38 digits."""

    def run(batches):
        total = per_task(batches)
        if total is None:
            return
        flat = np.asarray(total, object)
        i, j = np.nonzero(np.triu(np.ones(flat.shape, bool))) if flat.ndim == 2 else (np.arange(len(flat)), np.zeros(len(flat), np.int64))
        values = [str(v) for v in (flat[i, j] if flat.ndim == 2 else flat)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], ["i", "j", "v"])

    return rows.mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers."""
    if np.abs(y).max(initial=0) <= EXACT:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def eigen(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    scale = np.abs(a).max(initial=0.0) or 1.0
    a = np.asarray(a, np.longdouble) / np.longdouble(scale)
    _, x = np.linalg.eigh(a.astype(np.float32))
    x, one = x.astype(np.longdouble), np.eye(len(a), dtype=np.longdouble)
    tight, last = 64 * np.finfo(np.float64).eps, np.inf
    for k in range(rounds):
        r, s = one - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        far = values[None, :] - values[:, None]
        # what a division by the distance of two eigenvalues may lose
        bound = 2 * (np.abs(s - np.diag(values)).sum(1).max() + np.abs(a).sum(1).max() * np.abs(r).sum(1).max())
        split = np.abs(far) > bound
        e = np.where(split, (s + values[None, :] * r) / np.where(split, far, 1), r / 2)
        x = x + x @ e
        moved = float(np.abs(e).max(initial=0))
        if not (split | (one > 0)).all():
            turned = _solve_clusters(a, x, values, split)
            x = x if turned is None else turned
        if moved < tight and moved >= last / 4 or moved < np.finfo(np.longdouble).eps * 16:
            break
        last = moved
    r = one - x.T @ x
    x = x + x @ (r / 2)
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def _solve_clusters(a, x, values, split):
    """x with the columns of every cluster turned to the eigenvectors of the block of X'AX, less its mean, that belongs to it."""
    order, out = np.argsort(values), None
    start = 0
    for k in range(1, len(order) + 1):
        if k < len(order) and not split[order[k - 1], order[k]]:
            continue
        own, start = order[start:k], k
        if len(own) < 2:
            continue
        out = x.copy() if out is None else out
        q = out[:, own]
        for _ in range(2):  # unit and at right angles to each other
            q = q + q @ (np.eye(len(own), dtype=q.dtype) - q.T @ q) / 2
        middle = values[own].mean()
        block = q.T @ (a @ q - middle * q)
        block = (block + block.T) / 2
        size = np.abs(block).max()
        if size > 0:
            _, turn = np.linalg.eigh((block / size).astype(np.float64))
            q = q @ turn.astype(np.longdouble)
        out[:, own] = q
    return out


def fit(embeddings: DataFrame) -> Fit | None:
    """The covariance's eigenvectors over all remaining vectors; None without any.  d * (d + 1) / 2 numbers come to the driver for vectors
    of d entries, whatever the rows."""
    rows = remaining(embeddings)
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims, n = sizes["dims"], sizes["n"]

    def sums_of(batches):
        total = None
        for batch in batches:
            for part in slices([batch], ROWS):
                x = vectors_of(part, dims)[1]
                fits = np.abs(x).max(initial=0) < _LONG // ROWS
                own = (x if fits else x.astype(object)).sum(0).astype(object)
                total = own if total is None else total + own
        return total

    sums = [0] * dims
    for r in _summed(rows, sums_of):
        sums[r["i"]] = int(r["v"])
    centre = np.array([s // n for s in sums], np.int64)

    def products_of(batches):
        total = None
        for batch in batches:
            for part in slices([batch], ROWS):
                own = exact_products(vectors_of(part, dims)[1] - centre)
                total = own if total is None else total + own
        return total

    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]  # sums of the centred integers, below n
    a = np.zeros((dims, dims))
    for r in _summed(rows, products_of):
        i, j = r["i"], r["j"]
        a[i, j] = a[j, i] = (n * int(r["v"]) - rest[i] * rest[j]) / (n * n)  # rounded once
    values, components = eigen(a)
    return Fit(n, np.array(sums, object), values, components, float(np.trace(a)))


class Whitener:
    """What tasks need of a fit: it whitens the components whose eigenvalue is not zero but for rounding."""

    def __init__(self, model: Fit, most: int = COMPONENTS):
        keep = np.flatnonzero(model.values > max(model.values[0], 0) * len(model.values) * 4 * np.finfo(np.float64).eps)[:most]
        self.n, self.sums, self.dims = model.n, model.sums, len(model.values)
        self.map = model.components[:, keep] / np.sqrt(model.values[keep])
        self.explained = model.values[keep] / model.trace if model.trace else model.values[keep]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) <= _LONG:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def deviation(self, apart: np.ndarray) -> list:
        """The exact sum of squares of each row; null beyond a long."""
        most = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
        if most * most * self.dims <= _LONG:
            return (apart * apart).sum(1).tolist()
        return [v if v <= _LONG else None for v in (apart.astype(object) ** 2).sum(1)]

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(np.float64) / self.n) @ self.map


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For every row with a vector and each component up to ``components``: vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are vectors that do not have the
    most frequent length (of equally frequent ones the greatest).  Components without variance (eigenvalue zero but for rounding)
    cannot be whitened and have no rows; so equal vectors, or a single one, give none, as does an empty table.  Null and repeated
    vec_ids are rows like any other.  A deviation beyond a long is null.  Entries beyond 2**55 count as 2**55.  Only vec_id
    and embedding are read.
    """
    model = fit(embeddings)
    spark = embeddings.sparkSession
    if model is None or not len((white := Whitener(model, components)).explained):
        return spark.createDataFrame([], FIELDS)
    shared, rows = spark.sparkContext.broadcast(white), remaining(embeddings)
    k = len(white.explained)

    def moments(batches):
        total, count = np.zeros((k + 1, k)), 0
        for batch in batches:
            for part in slices([batch], ROWS):
                w = shared.value
                z = w.whitened(w.apart(vectors_of(part, w.dims)[1]))
                total[:k] += z.T @ z
                total[k] += z.sum(0)
                count += len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    found = rows.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:
        total[r["i"]] = r["v"]
    total = total.reshape(k + 1, k) / model.n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for part in slices([batch], ROWS):
                w = shared.value
                at, x = vectors_of(part, w.dims)
                apart = w.apart(x)
                rows = len(at)
                ids = column(part, "vec_id").take(pa.array(np.repeat(at, k)))
                away = pa.array(w.deviation(apart), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, w.n, np.int64)),
                        away,
                        pa.array(w.whitened(apart).ravel()),
                        pa.array(np.tile(w.explained, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    [f.split(" ")[0] for f in FIELDS.split(", ")],
                )

    return rows.mapInArrow(run, FIELDS)
