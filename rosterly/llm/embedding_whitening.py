"""Whitening of vectors: a pivoted Cholesky factor of their covariance, rotated to orthogonal columns by one-sided Jacobi.

The data is read four times and never moves: the number of vectors and their exact sums; the covariance, of vectors
centred before they are multiplied; the covariance of the whitened vectors, as a check; the result. Each task adds up its
rows and sends d or d * d partial sums, which are added in a shuffle; only those sums, bounded by the dimension and not
by the rows, reach the driver, and the components go back in a broadcast of 32 * d numbers.

With P' V P = L L' and L J = U D for the rotations J that make the columns of L orthogonal, V = (P U) D^2 (P U)': the
squared norms of the rotated columns are eigenvalues, the normalised columns components. The factor ends where what is
left is rounding, so a covariance of rank r has r components.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, trimmed

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Entries beyond this cannot be told from their neighbours once they are whole numbers in a double.
LARGEST = 2.0**53
WHITENED = "id bigint, component int, deviation bigint, whitened double"


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # of the whole numbers, as Python integers
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # d x number of components
    error: float  # largest absolute entry of the whitened vectors' covariance minus the identity


def usable(vec: Column) -> Column:
    """The vector as whole numbers floor(64 c) + 1,000,000; null where it is null, empty, or holds a null, an entry that is
    not finite or one whose whole number is not exact in a double."""
    c = vec.cast("array<double>")
    fits = F.forall(c, lambda v: F.coalesce(F.abs(v) * SCALE < LARGEST - OFFSET, F.lit(False)))
    return F.when((F.size(c) > 0) & fits, F.transform(c, lambda v: F.floor(v * SCALE) + OFFSET))


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (d x r, lower triangular) and the order of rows with v[order][:, order] = L L'."""
    a, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(float(np.diag(v).max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        if p != k:
            for m in (a, factor):
                m[[k, p]] = m[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The columns of a matrix rotated in pairs until all are orthogonal. Pairs are dealt as in a round-robin tournament, so
    that half of the columns meet the other half at once; a sweep of all pairs without a rotation ends it."""
    r = factor.shape[1]
    u = np.vstack([factor.T, np.zeros((r % 2, factor.shape[0]))])  # columns as rows; an odd one sits out with zeros
    ring, half, eps = np.arange(len(u)), len(u) // 2, np.finfo(float).eps
    for _ in range(100):
        turned = False
        for _ in range(len(u) - 1):
            i, j = ring[:half], ring[half:][::-1]
            x, y = u[i], u[j]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            far = np.abs(xy) > eps * np.sqrt(xx * yy)
            if far.any():
                turned = True
                zeta = (yy - xx)[far] / (2 * xy[far])
                tan = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, tan)
                sin = cos * tan
                u[i[far]] = cos[:, None] * x[far] - sin[:, None] * y[far]
                u[j[far]] = sin[:, None] * x[far] + cos[:, None] * y[far]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    return u[:r].T


def eigen(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a covariance, falling, and their unit vectors as columns. Of the two signs of a vector
    that is taken whose largest entry is positive."""
    factor, order = pivoted_cholesky(v)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(v), 0))
    u = orthogonal_columns(factor)
    norms = np.sqrt((u * u).sum(0))
    falling = np.argsort(-norms, kind="stable")[:most]
    vectors = np.empty((len(v), len(falling)))
    vectors[order] = u[:, falling] / norms[falling]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(falling))])
    return norms[falling] ** 2, vectors * signs


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n in doubles. The whole part of the mean is taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _partial_sums(rows: DataFrame, of_batch) -> np.ndarray:
    """The sums over all rows of the matrices of_batch(x): one partial matrix a task, added in a shuffle."""

    @trimmed
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                part = of_batch(_matrix(b.column("x")))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "v"])

    out = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((max((r.i for r in out), default=-1) + 1, max((r.j for r in out), default=-1) + 1))
    for r in out:
        m[r.i, r.j] = r.v
    return m


def _counted(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of rows and the exact sum of each entry, as Python integers."""

    @trimmed
    def run(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column("x"))
            if len(x):
                small = int(np.abs(x).max()) * len(x) < 2**62
                n, total = n + len(x), [t + int(s) for t, s in zip(total, (x if small else x.astype(object)).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "v"])

    out = rows.select("x").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.i: int(r.v) for r in out}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(d)], object)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x), the whole numbers of each vector that remains, and their dimension. Vectors must agree in length: of several
    lengths the commonest (of equally common ones the longest) is the table's, and vectors of another are left out."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), usable(F.col(vec_col)).alias("x")).where(F.col("x").isNotNull())
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    return rows.where(F.size("x") == d), d


def fitted(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of prepared rows: components by falling eigenvalue, at most `components` and at most the rank."""
    n, sums = _counted(rows, d)
    if not n:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0)

    def scatter(x):
        c = _centred(x, n, sums)
        return c.T @ c

    v = _partial_sums(rows, scatter) / n
    v = (v + v.T) / 2
    values, vectors = eigen(v, components)
    scaled = vectors / np.sqrt(values)

    def moments(x):
        w = np.hstack([_centred(x, n, sums) @ scaled, np.ones((len(x), 1))])
        return w.T @ w

    m = _partial_sums(rows, moments) / n
    covariance = m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1])
    error = float(np.abs(covariance - np.eye(len(values))).max()) if len(values) else 0.0
    return Whitening(n, sums, float(np.trace(v)), values, vectors, error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n x - sums)^2, exact; null where it needs more than 63 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    near = x - whole
    if (n * (float(np.abs(near).max()) + 1)) ** 2 * x.shape[1] < 2.0**62:
        y = n * near - np.array([s % n for s in sums], np.int64)
        return pa.array((y * y).sum(1))
    exact = (((near.astype(object) * n) - np.array([s % n for s in sums], object)) ** 2).sum(1)
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def transformed(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, component (from 1), deviation and whitened of prepared rows: a row for each vector and component."""
    n, sums, k = model.n, model.sums, len(model.values)
    scaled = rows.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values))

    @trimmed
    def run(batches):
        for b in batches:
            for at in range(0, len(b) if k else 0, 1000):
                part = b.slice(at, 1000)
                x = _matrix(part.column("x"))
                again = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), _deviations(x, n, sums).take(again),
                    pa.array((_centred(x, n, sums) @ scaled.value).ravel())], names=["id", "component", "deviation", "whitened"])

    return rows.mapInArrow(run, WHITENED)


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each remaining row and component.

    Rows whose vector is null, empty, of an uncommon length (see prepared), or holds a null or an entry that is not finite
    are left out; so are vectors with entries of 2^47 and more, whose whole numbers a double cannot hold. Repeated rows
    and ids each count and give rows; a null id stays null; other columns are ignored. A table without a remaining row,
    or whose remaining rows are all equal, has no component and gives an empty result. Components of equal eigenvalues
    are some orthogonal choice, the same for all rows.
    """
    rows, d = prepared(vectors, id_col, vec_col)
    model = fitted(rows, d, components)
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values)).cast("array<double>")
    return transformed(rows, model).select(
        F.col("id").alias("vec_id"), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(model.error).alias("identity_error"))


def op13_embedding_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
