"""Broadcast only what has a proven row bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast side is built on the driver and shipped to every executor; keep
# it to tables whose row count is known from the plan itself.
MAX_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, bound: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` when ``bound`` -- an upper bound on its rows
    that follows from how it was built (a literal list, a global aggregate,
    one row per input file) -- is within ``limit``.  Otherwise leave the join
    to the planner (shuffle join; AQE may still broadcast on measured size)."""
    return F.broadcast(df) if bound <= limit else df


def max_shuffle_partitions(spark) -> int:
    """Upper bound on the partitions a shuffle of this session produces."""
    conf = spark.conf
    n = int(conf.get("spark.sql.shuffle.partitions", "200"))
    init = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    if init:
        n = max(n, int(init))
    return max(n, 1)
