"""Embedding whitening: mean and covariance in one pass, then a rotation and scaling to unit covariance.

Each partition streams its vectors through Welford's rank-one update,

    d = x - mean;  mean += d / n;  M += (n - 1) / n * d d'

and the partitions' (n, mean, M) are merged by the parallel formula, M = M1 + M2 + d d' n1 n2 / n,
in a tree of small groups.  The covariance M / n goes through Householder's reduction to a
tridiagonal matrix and the symmetric QR iteration with Wilkinson's shifts.  Sums of whole numbers
are kept exactly beside them.  A second pass measures how far the whitened vectors' covariance is
from the identity.

Vectors become whole numbers first, x = floor(scale * c) + offset.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so
are vectors of another length than most (of lengths as frequent, the longest counts).  Entries
beyond 2**52 / scale count as that bound.  Components without variance (no more than dimension *
machine epsilon of the largest) are not returned, so equal vectors, one vector, or an empty table
give no rows.  `deviation` is exact, and null where a long cannot hold it.  Null and repeated
identifiers are carried as they are; every row counts.  Components of equal variance are any
orthogonal ones of their space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: States merged by one task.
FAN = 32
_LIMIT = 1 << 52
_STATE = "slot long, n long, low array<long>, high array<long>, mean array<double>, m2 array<double>"


class Moments:
    """Count, mean and the sum of centred products; rank-one updates, and merging."""

    def __init__(self, dim: int):
        self.n, self.mean, self.m2 = 0, np.zeros(dim), np.zeros((dim, dim))
        self._d, self._outer = np.zeros(dim), np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        d = np.subtract(x, self.mean, out=self._d)
        self.mean += d / self.n
        np.multiply(d[:, None], d, out=self._outer)
        self._outer *= (self.n - 1) / self.n
        self.m2 += self._outer

    def merge(self, n: int, mean: np.ndarray, m2: np.ndarray) -> None:
        if n:
            d, total = mean - self.mean, self.n + n
            self.m2 += m2 + np.outer(d, d) * (self.n * (n / total))
            self.mean += d * (n / total)
            self.n = total


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: the diagonal and the one beside it of q' a q, and q."""
    a, n = np.array(a, float), len(a)
    q, nothing = np.eye(n), np.finfo(float).eps ** 2 * np.linalg.norm(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.abs(v[1:]).max() <= nothing:  # also where squares would vanish
            a[k + 2 :, k] = 0.0
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, by the QR iteration with implicit shifts."""
    d, e, q = tridiagonal(a)
    q, tiny = q.T.copy(), np.finfo(float).eps  # rows are turned, as they are contiguous
    high, nothing = len(d) - 1, tiny**2 * np.linalg.norm(a)
    while high > 0:
        for k in range(high):
            if abs(e[k]) <= tiny * (abs(d[k]) + abs(d[k + 1])) + nothing:
                e[k] = 0.0
        while high > 0 and e[high - 1] == 0:
            high -= 1
        if high == 0:
            break
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            d0, d1, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * d0 + 2 * c * s * f + s * s * d1, s * s * d0 - 2 * c * s * f + c * c * d1
            e[k] = c * s * (d1 - d0) + (c * c - s * s) * f
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T / np.linalg.norm(q[order], axis=1)


@dataclass
class Whitener:
    """What `fit` learns: n, exact sums, and per component its eigenvalue and direction."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE
    offset: int = OFFSET
    identity_error: float = float("nan")

    @property
    def base(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the mean has beyond its whole part."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.rest / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exactly: in 64 bits, which wrap, where a float tells that the sum fits them."""
        diff, rest = x - self.base, self.rest
        about = ((diff * float(self.n) - rest) ** 2).sum(axis=1)
        wrapped = diff.astype(np.uint64) * np.uint64(self.n) - rest.astype(np.uint64)
        out: list[int | None] = (wrapped * wrapped).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()
        for k in np.flatnonzero(about > 2.0**63 * 0.999).tolist():
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[k], self.sums, strict=True)) if about[k] < 2.0**63 * 1.001 else 1 << 63
            out[k] = exact if exact < 1 << 63 else None
        return out


def whole(vectors: pa.Array, dim: int, scale: int, offset: int) -> np.ndarray:
    """Rows of whole numbers from lists of doubles that all have dim entries."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(c * scale), -_LIMIT, _LIMIT).astype(np.int64) + offset


def sound(vector: Column) -> Column:
    """Whether a vector of doubles is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def usable(rows: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """The rows of (ident, vector) that count, and their length: that of most of them if none is given."""
    rows = rows.where(sound(F.col("vector")) & (F.size("vector") > 0))
    if dim is None:
        most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = most.dim if most else 0
    return rows.where(F.size("vector") == dim), dim


def _fold(batches: Iterable[pa.RecordBatch], dim: int, scale: int, offset: int, model: Whitener | None) -> Iterator[pa.RecordBatch]:
    """One partition's moments: of the vectors themselves, or as the model whitens them."""
    out = Moments(dim if model is None else len(model.values))
    low, high = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for b in batches:
        x = whole(b.column(0), dim, scale, offset)
        low += (x & 0xFFFFFFFF).sum(axis=0)
        high += (x >> 32).sum(axis=0)
        for row in (x - offset).astype(float) if model is None else model.project(x):
            out.add(row)
    if out.n:
        cols = [[TaskContext.get().partitionId()], [out.n], [low], [high], [out.mean], [out.m2.ravel()]]
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.float64())] * 2]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["slot", "n", "low", "high", "mean", "m2"])


def _merge(states: pd.DataFrame) -> pd.DataFrame:
    states = states.sort_values("slot")
    dim = len(states["mean"].iloc[0])
    out, low, high = Moments(dim), 0, 0
    for n, lo, hi, mean, m2 in zip(*(states[c] for c in ("n", "low", "high", "mean", "m2")), strict=True):
        out.merge(n, np.array(mean), np.array(m2).reshape(dim, dim))
        low, high = low + np.array(lo), high + np.array(hi)
    high, low = high + (low >> 32), low & 0xFFFFFFFF
    return pd.DataFrame({"slot": [states["slot"].iloc[0] // FAN], "n": [out.n], "low": [low], "high": [high], "mean": [out.mean], "m2": [out.m2.ravel()]})


def moments(rows: DataFrame, dim: int, scale: int, offset: int, model: Whitener | None = None) -> tuple[Moments, list[int]] | None:
    """The moments of all vectors and their exact sums; one state a partition, merged FAN by FAN."""
    states = common.written(rows.select("vector").mapInArrow(lambda it: _fold(it, dim, scale, offset, model), _STATE), "moments")
    left = states.agg(F.max("slot")).first()[0]
    while left:  # slots 0 .. left
        states = states.groupBy((F.col("slot") / FAN).cast("long").alias("key")).applyInPandas(_merge, _STATE)
        left //= FAN
    last = states.collect()  # one row, of a size the dimension gives
    if not last:
        return None
    [r] = last
    out = Moments(len(r.mean))
    out.merge(r.n, np.array(r.mean), np.array(r.m2).reshape(len(r.mean), -1))
    return out, [lo + (hi << 32) for lo, hi in zip(r.low, r.high, strict=True)]


def fit(rows: DataFrame, dim: int, components: int | None = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitener | None:
    """Learn from (ident, vector) rows, all of that length; None where no component has variance."""
    found = moments(rows, dim, scale, offset)
    if found is None:
        return None
    m, sums = found
    v = m.m2 / m.n
    values, vectors = symmetric_qr((v + v.T) / 2)
    keep = int((values > dim * np.finfo(float).eps * max(values[0], 0.0)).sum())
    keep = min(keep, components or keep)
    if not keep:
        return None
    out = Whitener(m.n, sums, values[:keep], vectors[:, :keep], float(np.trace(v)), scale, offset)
    again, _ = moments(rows, dim, scale, offset, out)
    out.identity_error = float(np.abs(again.m2 / again.n - np.eye(keep)).max())
    return out


def _apply(batches: Iterable[pa.RecordBatch], model: Whitener) -> Iterator[pa.RecordBatch]:
    dim = len(model.sums)
    for b in batches:
        x = whole(b.column(1), dim, model.scale, model.offset)
        y = model.project(x)
        starts = pa.array(np.arange(len(y) + 1) * len(model.values), pa.int32())
        yield pa.record_batch([b.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(starts, pa.array(y.ravel()))], names=["ident", "deviation", "whitened"])


def transform(rows: DataFrame, model: Whitener) -> DataFrame:
    """ident, deviation, whitened (one double a component, by falling eigenvalue) of (ident, vector) rows."""
    kind = rows.schema["ident"].dataType.simpleString()
    return rows.select("ident", "vector").mapInArrow(lambda it: _apply(it, model), f"ident {kind}, deviation long, whitened array<double>")


def whiten(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int | None = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Whitener | None]:
    """Fit on all usable vectors and whiten them: (ident, deviation, whitened) rows, and the model."""
    common.ship(table.sparkSession)
    rows, dim = usable(table.select(F.col(common.quoted(ident)).alias("ident"), F.col(common.quoted(vector)).cast("array<double>").alias("vector")))
    model = fit(rows, dim, components, scale, offset) if dim else None
    if model is None:
        kind = rows.schema["ident"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"{common.quoted(ident)} {kind}, deviation long, whitened array<double>"), None
    return transform(rows, model).withColumnRenamed("ident", ident), model


def components_of(table: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: ident, component, n, deviation, whitened, explained, identity_error."""
    out, model = whiten(table, ident, vector)
    shares = F.array(*[F.lit(float(x)) for x in model.values / model.trace]) if model else F.lit(None).cast("array<double>")
    n, error = (F.lit(model.n if model else None).cast("long"), F.lit(model.identity_error if model else None).cast("double"))
    rows = out.select(ident, n.alias("n"), "deviation", error.alias("identity_error"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(ident, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, "at").alias("explained"), "identity_error")
