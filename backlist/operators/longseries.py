"""Fits and smoothing of series of any length.

``projections`` lays a series out as columns, which bounds its length when the
plan is built.  Here a series is cut into buckets of ``BUCKET`` periods.  Each
bucket, at most that many points, is one sorted pass that gives

* power sums of the periods about ``origin`` (the middle of the range keeps
  them well conditioned) and their products with the values;
* the affine map s -> f * s + b that the bucket's smoothing steps make of the
  state before it, and those of one and two steps less.

Both merge: power sums add, maps compose in the order of the buckets.  So a
series with a third of all points is spread over its buckets, no task sorts
more than a bucket or one row per bucket, and results don't depend on how rows
were shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.operators.projections import _COEF, _COEF2, ALPHA, CONFIDENCE, METHODS, _expanded, _lit

BUCKET = 1024


def _bucket_sql(alpha: float) -> str:
    """One pass over a bucket's points, sorted by period: (x, y) pairs."""
    a, keep = _lit(alpha), f"(1.0D - {_lit(alpha)})"
    zero = "named_struct('f', 1.0D, 'b', 0.0D, 'f1', CAST(NULL AS DOUBLE), 'b1', CAST(NULL AS DOUBLE), 'f2', CAST(NULL AS DOUBLE), " \
           "'b2', CAST(NULL AS DOUBLE), " + ", ".join(f"'{c}', 0.0D" for c in ("s1", "s2", "s3", "s4", "t0", "t1", "t2", "top")) + ")"
    x, y = "p.x", "p.y"
    step = (f"named_struct('f', {keep} * s.f, 'b', {a} * {y} + {keep} * s.b, 'f1', s.f, 'b1', s.b, 'f2', s.f1, 'b2', s.b1, "
            f"'s1', s.s1 + {x}, 's2', s.s2 + {x} * {x}, 's3', s.s3 + {x} * {x} * {x}, 's4', s.s4 + {x} * {x} * {x} * {x}, "
            f"'t0', s.t0 + {y}, 't1', s.t1 + {x} * {y}, 't2', s.t2 + {x} * {x} * {y}, 'top', greatest(s.top, abs({y})))")
    return f"aggregate(points, {zero}, (s, p) -> {step})"


_SUMS = ("s1", "s2", "s3", "s4", "t0", "t1", "t2")
# the state is the smoothed value after the last three points; before the
# first point it is that point's value, so the first step leaves it there
_MERGED = ("aggregate(parts, named_struct('s', parts[0].first, 'sa', CAST(NULL AS DOUBLE), 'sb', CAST(NULL AS DOUBLE), "
           + ", ".join(f"'{c}', 0.0D" for c in _SUMS) + ", 'n', 0L, 'top', 0.0D), (m, p) -> named_struct("
           "'s', p.own.f * m.s + p.own.b, 'sa', p.own.f1 * m.s + p.own.b1, "
           "'sb', coalesce(p.own.f2 * m.s + p.own.b2, m.sa), "
           + ", ".join(f"'{c}', m.{c} + p.own.{c}" for c in _SUMS) + ", 'n', m.n + p.n, 'top', greatest(m.top, p.own.top)))")


def fit_series(series: DataFrame, keys: Sequence[str], *, period: str, value: str, origin: int,
               alpha: float = ALPHA) -> DataFrame:
    """One row per series of ``series(keys..., period, value)``, which has one
    row per key and period (an integer): ``keys..., n``, the coefficients of
    the line and the parabola in ``period - origin``, first, last and largest
    values, the smoothed value ``s_n`` and its ``trend``.  Missing values count
    as 0; rows without a period are left out."""
    k = [f"`{c}`" for c in keys]
    points = series.where(F.col(period).isNotNull()).selectExpr(
        *k, f"CAST(floor((CAST(`{period}` AS BIGINT) - {origin}L) / {BUCKET}) AS BIGINT) AS _bucket",
        f"named_struct('x', CAST(CAST(`{period}` AS BIGINT) - {origin}L AS DOUBLE), "
        f"'y', coalesce(nanvl(CAST(`{value}` AS DOUBLE), 0.0D), 0.0D)) AS _p")
    parts = (points.groupBy(*keys, "_bucket").agg(F.array_sort(F.collect_list("_p")).alias("points"))
             .selectExpr(*k, "_bucket", "size(points) AS n", "points[0].y AS first", "element_at(points, -1).y AS last",
                         f"{_bucket_sql(alpha)} AS own"))
    entry = "array_sort(collect_list(named_struct('bucket', _bucket, 'n', CAST(n AS BIGINT), 'first', first, 'last', last, 'own', own)))"
    merged = parts.groupBy(*keys).agg(F.expr(entry).alias("parts")).selectExpr(*k, "parts", f"{_MERGED} AS m")
    stats = merged.selectExpr(
        *k, "m.n AS n", *[f"m.{c} AS {c.upper()}" for c in _SUMS], "parts[0].first AS y_first",
        "element_at(parts, -1).last AS y_last", "m.top AS y_absmax", "m.s AS s_n",
        "CASE WHEN m.n >= 3 THEN (m.s - m.sb) / 2.0D ELSE m.s - m.sa END AS trend")
    return stats.selectExpr("*", *_COEF).selectExpr("*", *_COEF2)


def project_series(series: DataFrame, keys: Sequence[str] = (), *, period: str, value: str, origin: int, last: int,
                   horizon: int, confidence: str = "Moderate", methods: Sequence[str] = METHODS,
                   alpha: float = ALPHA) -> DataFrame:
    """Forecasts ``keys..., method, period, value`` for the periods after
    ``last``, by the rules of ``projections`` (values floored at 0; series of
    fewer than two points give no rows)."""
    if horizon < 1:
        raise ValueError("horizon must be 1 or more")
    unknown = [m for m in methods if m not in METHODS]
    if unknown or confidence not in CONFIDENCE:
        raise ValueError(f"unknown methods {unknown} or confidence {confidence!r}")
    coef = fit_series(series, keys, period=period, value=value, origin=origin, alpha=alpha).where("n >= 2")
    k = [f"`{c}`" for c in keys]
    out = _expanded(coef.withColumn("metric", F.lit("total_sales")), k, [confidence], methods,
                    last_year=last, center=origin, horizon=horizon)
    return out.select(*keys, "method", F.col("year").alias("period"), "value")
