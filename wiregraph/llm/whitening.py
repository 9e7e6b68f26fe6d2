"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the spectrum of what it has read and applies one centred rank-one update a row (copies within a
batch are one weighted update): the secular equation gives the new eigenvalues, components that an update cannot move
are deflated, and the new vectors come from recomputed weights (Gu and Eisenstat, 1994), so they stay orthogonal. The
spectra of partitions are merged in a tree, again by rank-one updates. The leading vectors then span the first basis of
a Rayleigh-Ritz refinement over all rows, whose basis grows by the residuals until these are at rounding level.

What a task holds, and what reaches the driver, is bounded by the square of the vectors' length, not by the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget

EPS = float(np.finfo(float).eps)
#: Partial results that one task merges.
FAN_IN = 16
#: Vectors of the first basis beside those asked for, and the residual (relative to the largest eigenvalue) that ends the refinement.
SPARE, RESIDUAL = 8, 1e-13
#: Iterations of the secular equation by rational interpolation, before halving takes over.
STEPS = 40


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w_j^2 / (d_j - x)) for rising d without ties and w without zeros: (the roots, d_j - root_i by row i).

    Each root is sought as a distance from the nearer of the two poles around it, so that small distances are exact.
    """
    m, w2 = len(d), w * w
    gap = np.append(np.diff(d), w2.sum())
    rows = np.arange(m)
    mid = 1 + (w2 / (d - (d[:, None] + gap[:, None] / 2))).sum(1)
    right = (mid < 0) & (rows < m - 1)
    origin = rows + right
    poles = d - d[origin][:, None]
    low = np.where(right, -gap / 2, np.where(mid < 0, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(mid < 0, gap, gap / 2))
    x = (low + high) / 2
    left, last = np.tri(m), rows == m - 1
    pole_l, pole_r = poles[rows, rows], poles[rows, np.minimum(rows + 1, m - 1)]
    todo = rows
    for step in range(STEPS + 80):
        at = x[todo]
        away = poles[todo] - at[:, None]
        t = w2 / away
        f = 1 + t.sum(1)
        open_ = np.abs(f) > 4 * EPS * (1 + np.abs(t).sum(1))
        if not open_.all():
            todo, at, away, t, f = todo[open_], at[open_], away[open_], t[open_], f[open_]
        if not len(todo):
            break
        low[todo], high[todo] = np.where(f < 0, at, low[todo]), np.where(f < 0, high[todo], at)
        lo, hi, end = low[todo], high[todo], last[todo]
        new = (lo + hi) / 2
        if step < STEPS:
            t /= away
            slope_l = (t * left[todo]).sum(1)
            slope_r = t.sum(1) - slope_l
            a, b = pole_l[todo] - at, pole_r[todo] - at
            # left and right terms are replaced by a constant and a pole each, of the same value and slope here
            c = f - a * slope_l - np.where(end, 0.0, b * slope_r)
            p, q = (a + b) * f - a * b * (slope_l + slope_r), a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                guess = at + np.where(end, a + slope_l * a * a / c, np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root)))
            new = np.where((guess > lo) & (guess < hi), guess, new)
        x[todo] = new
        todo = todo[(new != at) & (hi - lo > 2 * EPS * np.abs(new))]
    return d[origin] + x, poles - x[:, None]


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of q diag(lam) q' + weight v v', for a weight of 0 or more."""
    z = (q.T @ v) * np.sqrt(weight)
    size = float(np.sqrt(z @ z))
    if size == 0:
        return lam, q
    lam, q = lam.copy(), q.copy()
    tiny = 8 * EPS * max(float(lam[-1]), size * size)
    close = np.diff(lam) <= tiny
    if close.any():
        # vectors of equal eigenvalues are turned until one of them carries the whole update
        ends = np.flatnonzero(~np.append(close, False))
        starts = np.append(0, ends[:-1] + 1)
        for s, e in zip(starts[ends > starts], ends[ends > starts] + 1):
            u = z[s:e].copy()
            norm = float(np.sqrt(u @ u))
            if norm > 0:
                norm = norm if u[-1] <= 0 else -norm
                u[-1] -= norm
                if (uu := float(u @ u)) > 0:
                    q[:, s:e] -= np.outer(q[:, s:e] @ u, u * (2 / uu))
                z[s:e] = 0.0
                z[e - 1] = norm
            lam[s:e] = lam[s:e].mean()
    moved = np.flatnonzero(np.abs(z) * size > tiny)
    if not len(moved):
        return lam, q
    d, m = lam[moved], len(moved)
    roots, away = secular_roots(d, z[moved])
    # the weights of which the roots found are the exact roots
    apart = np.abs(d - d[:, None])
    other = np.vstack([apart[1:], np.ones(m)])
    share = np.abs(away) / np.where(np.arange(m)[:, None] < np.arange(m), apart, other)
    exact = np.sqrt(np.prod(share, axis=0)) * np.sign(z[moved])
    u = exact / away
    u /= np.sqrt((u * u).sum(1))[:, None]
    q[:, moved] = q[:, moved] @ u.T
    lam[moved] = roots
    if (np.diff(lam) < 0).any():
        order = np.argsort(lam, kind="stable")
        lam, q = lam[order], np.ascontiguousarray(q[:, order])
    return lam, q


class Spectrum:
    """Rows, exact sums and the eigendecomposition of the scatter around the mean."""

    def __init__(self, n: int, sums: np.ndarray, lam: np.ndarray, q: np.ndarray):
        self.n, self.sums, self.lam, self.q = n, sums, lam, q

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray, times: int = 1) -> None:
        """One integer vector, so many times."""
        if self.n:
            v = (self.n * x - self.sums) / self.n
            self.lam, self.q = rank_one(self.lam, self.q, v, self.n * times / (self.n + times))
        self.n, self.sums = self.n + times, self.sums + times * x

    def merge(self, other: Spectrum) -> None:
        """Adds what another one has read: an update for each of its eigenvectors, and one for the distance of the means."""
        if self.n and other.n:
            for lam, v in zip(other.lam, other.q.T):
                if lam > 0:
                    self.lam, self.q = rank_one(self.lam, self.q, v, lam)
            a, b = self.n, other.n
            apart = np.array([int(p) * b - int(r) * a for p, r in zip(self.sums, other.sums)], object) / (a * b)
            self.lam, self.q = rank_one(self.lam, self.q, apart.astype(float), a * b / (a + b))
        elif other.n:
            self.lam, self.q = other.lam, other.q
        self.n, self.sums = self.n + other.n, self.sums + other.sums

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "sums": [self.sums], "lam": [self.lam], "q": [self.q.tobytes()]})

    @classmethod
    def of(cls, r) -> Spectrum:
        lam = np.array(r.lam, float)
        return cls(int(r.n), np.array(r.sums, np.int64), lam, np.frombuffer(r.q).reshape(len(lam), len(lam)))


def integers(df: DataFrame, vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """The rows whose vector is there and finite in each entry, the vector as longs floor(scale * c) + shift."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    # coalesced, since a vector with nulls leaves the test itself null
    return df.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).withColumn(vector, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _tree(parts: DataFrame, fold: Callable[[pd.DataFrame, int], pd.DataFrame]) -> pd.DataFrame | None:
    """Partial results (part, ...) merged FAN_IN at a time, in the order of their numbers, until one is left; None where there is none."""
    now = durable(parts)
    schema = now.schema
    while (n := now.count()) > 1:
        merged = durable(now.groupBy(F.floor(F.col("part") / FAN_IN).alias("at")).applyInPandas(lambda key, g: fold(g.sort_values("part"), int(key[0])), schema))
        forget(now)
        now = merged
    out = now.toPandas() if n else None
    forget(now)
    return out


def _sum(rows: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `make` gives for a block of them (an array of the same length each time)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                got = make(_matrix(b.column(0), d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "total"])

    parts = rows.select("v").mapInArrow(partial, "part long, total array<double>")
    found = _tree(parts, lambda g, at: pd.DataFrame({"part": [at], "total": [np.sum(np.stack(list(g["total"])), axis=0)]}))
    return np.array(found["total"].iloc[0])


def spectrum(rows: DataFrame, d: int) -> Spectrum:
    """The merged spectrum of all rows (v: array of long, d entries each)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = Spectrum.empty(d)
        for b in batches:
            if len(b):
                x, times = np.unique(np.stack(list(b["v"])).astype(np.int64), axis=0, return_counts=True)
                for v, k in zip(x, times):
                    own.add(v, int(k))
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    def fold(g: pd.DataFrame, at: int) -> pd.DataFrame:
        first, *rest = [Spectrum.of(r) for r in g.itertuples()]
        for other in rest:
            first.merge(other)
        return first.row(at)

    found = _tree(rows.select("v").mapInPandas(partial, "part long, n long, sums array<long>, lam array<double>, q binary"), fold)
    return Spectrum.empty(d) if found is None else Spectrum.of(next(found.itertuples()))


def refine(rows: DataFrame, start: Spectrum, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, vectors as columns, trace) of the covariance, the first k at rounding level.

    Each pass multiplies the covariance with the basis over all rows. While a residual is too large, the basis gets the
    residuals as well; at full length it spans everything, so the passes end.
    """
    d, n, sums = len(start.lam), start.n, start.sums
    basis = start.q[:, ::-1][:, : min(d, k + SPARE)]
    while True:
        b = basis

        def make(x: np.ndarray, b: np.ndarray = b) -> np.ndarray:
            c = (n * x - sums) / n
            return np.append((c.T @ (c @ b)).ravel(), (c * c).sum())

        total = _sum(rows, d, make)
        image, trace = total[:-1].reshape(d, -1) / n, total[-1] / n
        h = b.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = b @ turn
        rest = (image @ turn - vectors * values)[:, :k]
        if b.shape[1] == d or np.sqrt((rest * rest).sum(0)).max() <= RESIDUAL * max(values[0], 0.0):
            break
        new, _ = np.linalg.qr(np.hstack([vectors, rest]))
        basis = new[:, : min(d, b.shape[1] + k)]
    vectors = vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values[:k], vectors, float(trace)


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and leading component.

    Rows whose vector is null or holds null or non-finite entries are dropped; a null id stays null, repeated rows count
    and come out each. Components whose eigenvalue is zero to rounding (at most d * 2.2e-16 of the trace, as with one row
    or equal rows) cannot be whitened and give no rows; nor does an empty table or one of vectors without entries.
    Vectors of different lengths, and entries that leave the exact range of a long, are a ValueError. Signs: the entry of
    largest size of each eigenvector is positive. Other columns are not read, so their names cannot clash.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.max(F.abs(F.array_max("v"))).alias("x"), F.max(F.abs(F.array_min("v"))).alias("y")).first()
    d = seen["b"] or 0
    if seen["a"] != seen["b"]:
        raise ValueError(f"vectors of {seen['a']} to {seen['b']} entries")
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    if max(seen["x"], seen["y"]) * 2 * seen["n"] >= 2**62:
        raise ValueError("entries too large for exact sums")
    found = spectrum(rows, d)
    n, sums = found.n, found.sums
    values, vectors, trace = refine(rows, found, min(k, d))
    good = values > d * EPS * max(trace, 0.0)
    values, vectors = values[good], vectors[:, good]
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    turn, m = vectors / np.sqrt(values), len(values)

    def products(x: np.ndarray) -> np.ndarray:
        t = ((n * x - sums) / n) @ turn
        return np.append((t.T @ t).ravel(), t.sum(0))

    total = _sum(rows, d, products)
    mean = total[m * m :] / n
    error = float(np.abs(total[: m * m].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
    explained = values / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = n * _matrix(b.column(1), d) - sums
            if float(np.abs(c).max()) ** 2 * d < 2**62:
                far = (c * c).sum(1)
            else:
                far = [sum(int(v) ** 2 for v in r) for r in c]
                if max(far) >= 2**63:
                    raise ValueError("a deviation is too large for a long")
            t, size = (c / n) @ turn, b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(size), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)), pa.array(np.full(size * m, n)), pa.array(np.repeat(np.asarray(far, np.int64), m)), pa.array(t.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * m, error))], names=[x.split()[0] for x in schema.split(", ")])

    return rows.select(F.col("id").cast("long"), "v").mapInArrow(emit, schema)
