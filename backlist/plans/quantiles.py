"""Exact linear-interpolated quantiles that scale past one task.

Spark's exact ``percentile`` keeps a value->count map per group, which for a
global quantile over billions of distinct values lands in one task.  Here
the column is range-partitioned and sorted (a distributed sort), each row's
global rank is ``offset(partition) + position``, and only the (at most two
per probability) rows at the needed ranks are kept.  Offsets and positions must
come from one and the same ordering (every range sort samples for itself), so
the ordered column is checkpointed in the shared folder and read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backlist.plans.guards import bounded_broadcast, max_shuffle_partitions
from backlist.session import checkpoint_root


def lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (the form pandas ``quantile`` uses)."""
    d = b - a
    return F.when(t >= F.lit(0.5), b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, tiebreak: str | None = None) -> DataFrame:
    """One row with a DOUBLE column per probability (NULL on empty input).

    Positions follow pandas' default: ``p * (n - 1)`` interpolated linearly
    between the neighbouring order statistics.  ``tiebreak`` (a unique
    column, e.g. a row id) is a secondary sort key so that a value shared by
    a large share of rows (zero sales...) is spread over many range
    partitions instead of landing in one task; without it the row's
    position in its input partition is used.
    """
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    tb = F.col(tiebreak) if tiebreak else F.monotonically_increasing_id()
    v = df.select(F.col(value).cast("double").alias("v"), tb.alias("_tb")).where(F.col("v").isNotNull())

    ordered = v.orderBy("v", "_tb").select(
        "v", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    checkpoint_root(df.sparkSession)
    ordered = ordered.checkpoint(eager=True)
    per_part = ordered.groupBy("_pid").agg(F.min("_mid").alias("_first"),
                                            F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sort partition: its offset, and the total row count riding along
    offsets = per_part.select("_pid", "_first",
                              F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                              F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    n_parts = max_shuffle_partitions(df.sparkSession)

    def position(p: float, n):
        return F.lit(float(p)) * (n - F.lit(1)).cast("double")

    ranked = (ordered.join(bounded_broadcast(offsets, n_parts), "_pid")
              .select("v", "_n", (F.col("_off") + F.col("_mid") - F.col("_first")).alias("_rank")))
    wanted = [F.floor(position(p, F.col("_n"))).cast("bigint") for p in probs] + \
        [F.ceil(position(p, F.col("_n"))).cast("bigint") for p in probs]
    picked = ranked.where(F.col("_rank").isin(*wanted))
    # at most 2*len(probs) rows: gather them into one row by rank
    out = picked.agg(F.max("_n").alias("n"),
                     F.map_from_entries(F.collect_list(F.struct("_rank", "v"))).alias("m"))
    cols = []
    for p, name in zip(probs, names):
        x = position(p, F.col("n"))
        lo = F.try_element_at("m", F.floor(x).cast("bigint"))
        hi = F.try_element_at("m", F.ceil(x).cast("bigint"))
        t = x - F.floor(x)
        cols.append(F.when(F.col("n") > 0, lerp(lo, hi, t)).alias(name))
    return out.select(*cols)
