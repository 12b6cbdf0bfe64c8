"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become integers first, so that counts, sums and deviations are exact.
The fit list holds each distinct integer vector once.  Tasks add up its
centred products; the driver gets one scatter matrix, whose size is the square
of the dimension whatever the number of rows.  The matrix is factored as F F'
with diagonal pivoting, and the columns of the factor are rotated in pairs
until they are orthogonal: their squared norms are the eigenvalues, and the
normalised columns are the components.  The scatter is never multiplied by
itself, so small eigenvalues keep their relative accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.llm.common import without
from cutover.session import stage

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Largest cosine between two rotated columns of the factor that counts as orthogonal.
ORTHOGONAL = 1e-14
SWEEPS = 60

_INSIDE = 2**62


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, sums per dimension, components (one per row) and eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    finite = F.forall(vector, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def as_integers(vector: Column) -> Column:
    return F.transform(vector, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F with F F' = ``a``, one column per pivot, largest remaining diagonal first.

    Rows are in the order of ``a``; in the order of the pivots the factor is
    triangular.  It has as many columns as ``a`` has rank.
    """
    d = len(a)
    factor, left, open_ = np.zeros((d, d)), np.diag(a).astype(float), np.ones(d, bool)
    least = left.max(initial=0.0) * d * np.finfo(float).eps
    for k in range(d):
        pivot = int(np.argmax(np.where(open_, left, -np.inf)))
        if not left[pivot] > least:
            return factor[:, :k]
        column = (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[~open_] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        factor[:, k] = column
        open_[pivot] = False
        left = left - column**2
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairings of n columns in which every two columns meet once."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], reversed(seats[half:])) if max(a, b) < n]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def rotated_columns(factor: np.ndarray) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal; the pairs of a round are apart and turn together."""
    f = factor.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in _rounds(f.shape[1]):
            a, b = f[:, i], f[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            scale = np.sqrt(aa * bb)
            cosine = np.abs(np.divide(ab, scale, out=np.zeros_like(ab), where=scale > 0))
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > np.finfo(float).eps
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            f[:, i], f[:, j] = c * (a - t * b), c * (b + t * a)
        if worst <= ORTHOGONAL:
            break
    return f


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; as many as the rank.

    The largest entry of each eigenvector is positive, so that the sign is the same in every run.
    """
    f = rotated_columns(pivoted_cholesky(covariance))
    values = (f * f).sum(0)
    order = np.argsort(-values, kind="stable")
    vectors = (f[:, order] / np.sqrt(values[order])).T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.ones(0)
    return values[order], vectors * signs[:, None]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(df: DataFrame, column: str, d: int, width: int, products) -> np.ndarray:
    """The sum over all rows of ``products`` (rows x d integers -> d x width or 1 x width), added per task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = products(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    kind = "double" if width else "long"
    parts = df.select(column).mapInArrow(run, f"i long, j long, v {kind}")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("v") if width else F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros((max((r.i for r in summed), default=-1) + 1, width or d), float if width else object)
    for r in summed:
        out[r.i, r.j] = r.v if width else int(r.v)
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S in 64-bit integers."""
    return x * np.int64(n) - sums


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the usable vectors of ``df``; None if there are none.

    Repeated vectors count once.  If lengths differ, the length that most
    distinct vectors have (the smallest of those that tie) is fitted.
    Components with eigenvalue 0 have no whitened values and are left out, so
    that equal vectors only give a fit without components.
    """
    known = df.filter(usable(F.col(vector))).select(as_integers(F.col(vector)).alias("x")).distinct()
    # read several times; written once
    known = stage(known, "whitening")
    lengths = known.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return None
    d, n = lengths.d, lengths.n
    known = known.filter(F.size("x") == d)
    sums = _added(known, "x", d, 0, lambda x: x.sum(0, dtype=np.int64)[None, :])[0]
    whole = sums.astype(np.int64)

    def scatter(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, whole) / n
        return c.T @ c

    covariance = _added(known, "x", d, d, scatter) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = principal(covariance)
    values, vectors = values[:components], vectors[:components]
    k = len(values)
    error = 0.0
    if k:
        scale = (vectors / np.sqrt(values)[:, None]).T

        def products(x: np.ndarray) -> np.ndarray:
            z = (centred(x, n, whole) / n) @ scale
            return z.T @ z

        error = float(np.abs(_added(known, "x", d, k, products) / n - np.eye(k)).max())
    return Whitening(n, tuple(int(s) for s in sums), vectors, values, float(np.trace(covariance)), error)


def whitened(df: DataFrame, fitted: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows whose vector can be whitened, with ``deviation`` and ``whitened``.

    Rows whose vector is null, empty, not finite or of another length than the
    fitted one are left out; repeated rows get results equal up to rounding.  ``deviation``
    is the exact sum of (n*x - S)^2, null where it does not fit a long;
    ``whitened`` has one double per component.
    """
    kept = without(df, ["deviation", "whitened"])
    schema = T.StructType([*kept.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if fitted is None:
        return kept.limit(0).select("*", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    n, whole, d = fitted.n, np.array(fitted.sums, np.int64), fitted.dimension
    scale = (fitted.components / np.sqrt(fitted.values)[:, None]).T
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(names) - 2), d)
            c = centred(x, n, whole)
            z = (c / n) @ scale
            if (c.astype(float) ** 2).sum(1).max(initial=0.0) < _INSIDE:
                deviation = pa.array((c * c).sum(1))
            else:
                exact = [sum(int(e) ** 2 for e in row) for row in c]
                deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
            lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32) if z.shape[1] else np.zeros(len(z) + 1, np.int32), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], deviation, lists], names=names)

    fits = usable(F.col(vector)) & (F.size(vector) == d)
    own = "_x"
    while own in {c.lower() for c in kept.columns}:
        own += "_"
    return kept.filter(fits).withColumn(own, as_integers(F.col(vector))).mapInArrow(run, schema)


def by_component(df: DataFrame, fitted: Whitening | None) -> DataFrame:
    """One row per row of ``whitened`` and component, numbered from 1, with n, ``explained`` and ``identity_error``."""
    added = ["whitened", "component", "n", "explained", "identity_error"]
    kept = without(df, added).columns
    at = F.col("component") - 1
    one = df.select(*(df[c] for c in kept), F.posexplode("whitened").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    if fitted is None:
        shares, n, error = F.array().cast("array<double>"), F.lit(None).cast("long"), F.lit(None).cast("double")
    else:
        shares = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values)).cast("array<double>")
        n, error = F.lit(fitted.n).cast("long"), F.lit(fitted.identity_error)
    return one.withColumns({"n": n, "explained": F.get(shares, at), "identity_error": error})
