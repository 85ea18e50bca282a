"""Whitening of embeddings with a covariance by polarisation.

A vector's entries c become integers x = floor(256 c).  The fit list is each
distinct x vector once.  One pass gives n and every dimension's exact sum S;
a second one the exact sums of squares of the centred entries, of every
dimension and of the sum of every two dimensions.  These are variances, and
Var(a + b) - Var(a) - Var(b) is twice the covariance of a and b.

Centring keeps whole numbers: y = x - floor(S / n) is summed in integers, and
the rest of the mean, less than one, comes off in the exact total
n sum(u^2) - (sum u)^2.  No rounding occurs before the covariance matrix, which
is as large as the dimension's square and goes to ``eigh`` on the driver.

Defined cases: null vectors and those with null or non-finite entries are
dropped; null and repeated ids are rows of their own; equal vectors are fitted
once and all returned; vectors of each length are fitted on their own, and an
empty vector has no components; entries beyond a long's range count as its
limits; a component without variance has null ``whitened`` and is left out of
``identity_error``; without any variance ``explained`` is null too; a
``deviation`` that a long can't hold is null; equal eigenvalues have any basis,
the same for all rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import map_arrow, materialize

SCALE = 256
COMPONENTS = 4
_LONG = 1 << 63


@dataclass
class Fit:
    """Of one vector length; ``axes`` has a row for each component, over the
    square root of its eigenvalue."""

    n: int
    sums: list[int]
    floor: np.ndarray
    rest: list[int]
    axes: np.ndarray
    explained: list[float | None]
    error: float | None = None


def sound(column: str = "embedding"):
    """Whether a vector and all its entries are there and finite."""
    v = F.col(column)
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def scaled(column: str = "embedding"):
    return F.transform(F.col(column), lambda c: F.floor(c.cast("double") * SCALE))


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal vector length, with their vectors as a matrix."""
    for b in batches:
        lists = b.column(b.schema.names.index(column))
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(size[size > 0]):
            part = b.filter(pa.array(size == d)) if (size != d).any() else b
            yield part, part.column(b.schema.names.index(column)).flatten().to_numpy().reshape(-1, d)


def _wide(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is if ``bound`` fits a long, else as Python integers."""
    return x if bound < _LONG else x.astype(object)


def _top(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def _totals(fit: DataFrame, keys: list[str], add) -> list:
    """Sums over the fit list: ``add(x)`` gives a matrix of vectors' own sums,
    ``{key: total}``, which are combined per task and then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for _, x in matrices(batches):
            for k, v in add(x):
                old = own.get(k)
                own[k] = v.astype(object) if old is None else old + v
        for k, v in own.items():
            out = [pa.array([c] * len(v), pa.int32()) for c in k]
            out += [pa.array(np.arange(len(v)), pa.int32()), pa.array(list(v), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(out, [*keys, "j", "total"])

    schema = ", ".join([*(f"{k} int" for k in keys), "j int, total decimal(38,0)"])
    return map_arrow(fit, run, schema).groupBy(*keys, "j").agg(F.sum("total").alias("total")).collect()


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fits of ``fit(x)``, distinct integer vectors, by vector length."""

    def first(x: np.ndarray):
        d = x.shape[1]
        yield (d,), np.append(_wide(x, _top(x) * len(x)).sum(axis=0).astype(object), len(x))

    sums: dict[int, dict[int, int]] = {}
    for r in _totals(fit, ["d"], first):
        sums.setdefault(r["d"], {})[r["j"]] = int(r["total"])
    n = {d: s[d] for d, s in sums.items()}
    total = {d: [s[j] for j in range(d)] for d, s in sums.items()}
    floor = {d: np.array([s // n[d] for s in total[d]], dtype=np.int64) for d in n}

    def squares(x: np.ndarray):
        d = x.shape[1]
        y = _wide(x, 2 * _top(x)) - floor[d]
        y = _wide(y, 4 * _top(y) ** 2 * len(y))
        for i in range(d):
            u = np.concatenate([y[:, i:i + 1], y[:, i + 1:] + y[:, i:i + 1]], axis=1)
            # entry j - i: the dimension itself, then its sums with the later ones
            yield (d, i), (u * u).sum(axis=0)

    square = {(r["d"], r["i"], r["i"] + r["j"]): int(r["total"]) for r in _totals(fit, ["d", "i"], squares)}
    out = {}
    for d in n:
        rest = [s - n[d] * int(f) for s, f in zip(total[d], floor[d])]
        # n^2 times the variance of a dimension or of a sum of two
        var = {(i, j): n[d] * square[d, i, j] - (rest[i] + (rest[j] if j != i else 0)) ** 2 for i in range(d) for j in range(i, d)}
        v = np.empty((d, d))
        for (i, j), q in var.items():
            v[i, j] = v[j, i] = q / n[d] ** 2 if i == j else (q - var[i, i] - var[j, j]) / (2 * n[d] ** 2)
        e, axes = np.linalg.eigh(v)
        e, axes = e[::-1][:components], axes[:, ::-1][:, :components].T
        axes = axes * np.where(axes[np.arange(len(axes)), np.argmax(abs(axes), axis=1)] < 0, -1.0, 1.0)[:, None]
        trace = sum(var[i, i] for i in range(d)) / n[d] ** 2
        e = np.where(e > d * np.finfo(float).eps * trace, e, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            axes = np.where(e[:, None] > 0, axes / np.sqrt(e)[:, None], np.nan)
        out[d] = Fit(n[d], total[d], floor[d], rest, axes, [float(x / trace) if trace else None for x in e])
    return out


def project(x: np.ndarray, f: Fit) -> np.ndarray:
    """``(rows, components)`` whitened values; NaN where there is no variance."""
    y = _wide(x, 2 * _top(x)) - f.floor
    return (y.astype(float) - np.array([r / f.n for r in f.rest])) @ f.axes.T


def deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S)^2."""
    y = _wide(x, 2 * _top(x)) - f.floor
    bound = (f.n * (_top(y) + 1)) ** 2 * x.shape[1]
    z = _wide(y, bound) * f.n - (np.array(f.rest, dtype=object) if bound >= _LONG else np.array(f.rest, dtype=np.int64))
    return [int(s) if s < _LONG else None for s in (z * z).sum(axis=1).tolist()]


def _identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest entry of the whitened fit list's covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for _, x in matrices(batches):
            w = np.insert(project(x, fits[x.shape[1]]), 0, 1.0, axis=1)
            own[x.shape[1]] = own.get(x.shape[1], 0) + w.T @ w
        for d, m in own.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array([d] * m.size, pa.int32()), pa.array(i.ravel(), pa.int32()),
                                              pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], ["d", "i", "j", "s"])

    got = map_arrow(fit, run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = {}
    for d, f in fits.items():
        m = {(r["i"], r["j"]): r["s"] / f.n for r in got if r["d"] == d}
        have = [k + 1 for k in range(len(f.axes)) if not np.isnan(f.axes[k, 0])]
        if have:
            out[d] = max(abs(m[i, j] - m[0, i] * m[0, j] - (i == j)) for i in have for j in have)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)`` of every sound row of ``vectors(vec_id, embedding)``."""
    rows = vectors.where(sound()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled().alias("x"))
    fit = materialize(rows.select("x").where(F.size("x") > 0).distinct(), "fit-list")
    fits = fit_whitening(fit, components)
    for d, e in _identity_errors(fit, fits).items():
        fits[d].error = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches):
            f = fits[x.shape[1]]
            k, w = len(f.axes), project(x, f).ravel()
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array([f.n] * len(each), pa.int64()), pa.array(deviations(x, f), pa.int64()).take(pa.array(each)),
                 pa.array(w, mask=np.isnan(w)), pa.array(f.explained * len(x), pa.float64()),
                 pa.array([f.error] * len(each), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                "identity_error double")
