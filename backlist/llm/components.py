"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import materialize

MAX_ROUNDS = 60


def _digest(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, root)`` for every node of ``edges(a, b)`` but the roots themselves,
    where root is the smallest node of a's component.

    Every round replaces each node's larger neighbours' edges by edges to the
    smallest node it sees, so the edge count never grows and the rounds are
    logarithmic in the longest path.  State between rounds is a written table,
    and so are the smallest neighbours: both sides of a join come straight from
    a shuffle, so the edges of a hub can be split.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    e = materialize(edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct(), "edges")
    seen = _digest(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .distinct(), "stars")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        e = materialize(large.join(least, "a")
                        .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                                  F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                        .select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select("a", F.col("b").alias("root"))
