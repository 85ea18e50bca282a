"""Quantiles from mergeable sketches, with a stated rank error.

The sketch is Spark's own KLL aggregate: every task keeps a few thousand
values, sketches of tasks, groups or days merge into one, and nothing is
sorted or shuffled but the sketches.  ``exact_quantiles`` gives exact values
for a range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4096


def rank_error(size: int = SIZE) -> float:
    """The share of rows by which a quantile's rank is off at most, in 99 of 100
    sketches (the published constants of KLL); results are checked against
    twice that, which no sketch in practice exceeds."""
    return 2.296 / size ** 0.9021


def sketch(value: Column | str, size: int = SIZE) -> Column:
    """Aggregate: the sketch of a numeric column (NULL and NaN are left out)."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(size))


def merged(sketches: Column | str, size: int = SIZE) -> Column:
    """Aggregate: one sketch of all rows that the given ones saw."""
    return F.kll_merge_agg_double(sketches, F.lit(size))


def quantiles(sketches: Column | str, probs: Sequence[float]) -> Column:
    """The values at the given probabilities, as an array."""
    return F.kll_sketch_get_quantile_double(sketches, F.array(*[F.lit(float(p)) for p in probs]))


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``keys..., n, quantiles`` with one map-side combined aggregate."""
    own = df.groupBy(*keys).agg(sketch(value, size).alias("s"))
    return own.select(*keys, F.kll_sketch_get_n_double("s").alias("n"), quantiles("s", probs).alias("quantiles"))


def rank_span(df: DataFrame, value: str, probs: Sequence[float], estimates: Sequence[float]) -> DataFrame:
    """``p, estimate, n, below, upto``: how many rows lie below and up to each
    estimate (one pass)."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).agg(F.count(F.lit(1)).alias("n"), *[
        c for i, e in enumerate(estimates) for c in (F.count_if(v < F.lit(e)).alias(f"lo{i}"), F.count_if(v <= F.lit(e)).alias(f"hi{i}"))])
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.lit(e).alias("estimate"), F.col("n"), F.col(f"lo{i}").alias("below"),
                 F.col(f"hi{i}").alias("upto")) for i, (p, e) in enumerate(zip(probs, estimates))])))
