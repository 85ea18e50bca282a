"""Hard-negative mining with score bounds along a spanning tree of the anchors.

Scores are integer inner products of the vectors floor(256 c).  Anchors are
dealt to blocks; each block has a minimum spanning tree by Euclidean distance.
A candidate's score at a child anchor is within (distance to the parent) x
(candidate's norm) of its score at the parent, or of the interval known there.
Along the tree each candidate's interval is compared with the anchor's windows,
and only candidates whose interval overlaps one are scored exactly.  The low
end of a window rises to its k-th best score found so far.

Two searches of this kind: an anchor's positives are its best rows of the same
label (a window open above); its negatives for each positive are the best rows
of other labels with a score between ``LOW`` and ``HIGH`` % of the positive's.

Rows are dealt to shards by row number and anchors to blocks of about
``BLOCK_ANCHORS``; every (shard, block) pair is one bounded group, and the best
of all groups are merged by a window function.  Anchors are a stated share of
the rows, so the pairs to bound grow with the square of the rows; how many are
scored exactly depends on how closely the vectors lie.

Defined cases: null, unsound or empty vectors, null labels and null ids take no
part; vectors are compared with those of equal length; ties go to the smaller
id; rows with repeated ids, equal or not, are rows of their own, each a
candidate of the others; fewer rows than asked for return all; an anchor
without positives, or a positive below zero, returns nothing; a score beyond a
long's range is an error; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backlist.llm.common import materialize, ship
from backlist.llm.whitening import scaled, sound

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SHARD_ROWS = 65_536
BLOCK_ANCHORS = 4_096
CHUNK = 1_024  # candidates bounded at once
_TOP = 1 << 62
_EXACT = 1 << 53
_MARGIN = 1 + 1e-9  # above all rounding of distances and norms


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, parent, edge)``: the rows in the order in which they join the
    minimum spanning tree, each with its parent (-1 for the root) and distance."""
    x, n = x.astype(float), len(x)
    order, parent, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.full(n, np.inf)
    out, k = np.ones(n, dtype=bool), 0
    for i in range(n):
        order[i], out[k] = k, False
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        nearer = out & (d < edge)
        edge[nearer], parent[nearer] = d[nearer], k
        k = int(np.argmin(np.where(out, edge, np.inf)))
    edge[order[0]] = 0.0
    return order, parent, edge


def _products(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows with ``a``."""
    return (x @ a).astype(np.int64) if x.dtype != object else np.array((x @ a).tolist(), dtype=np.int64)


class Best:
    """The best k (score, id) of a window, ties to the smaller id."""

    def __init__(self, low: int, high: int, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        inside = (score >= self.low) & (score <= self.high)
        if inside.any():
            score, ids = np.append(self.score, score[inside]), np.append(self.id, ids[inside])
            best = np.lexsort((ids, -score))[:self.k]
            self.score, self.id = score[best], ids[best]
            if len(best) == self.k:
                self.low = int(self.score[-1])


def search(rows: dict[str, np.ndarray], anchors: dict[str, np.ndarray], windows: list[list[Best]], same: bool) -> int:
    """Fills the windows of every anchor with rows of the same label, or of
    others; returns how many scores were computed.

    ``rows`` and ``anchors`` have x, row, vec_id and label."""
    x, a = rows["x"], anchors["x"]
    bound = int(abs(x).max()) * int(abs(a).max()) * x.shape[1] if len(x) and len(a) else 0
    kind = float if bound < _EXACT else object
    a = a.astype(kind)
    order, parent, edge = spanning_tree(anchors["x"])
    edge, at, scored = edge * _MARGIN, np.argsort(order), 0
    slack = bound * 2.0 ** -50  # above the rounding of a score as a float
    for lo_row in range(0, len(x), CHUNK):
        c = {k: v[lo_row:lo_row + CHUNK] for k, v in rows.items()}
        xc = c["x"].astype(kind)
        norm = np.sqrt((c["x"].astype(float) ** 2).sum(axis=1)) * _MARGIN
        low, high = np.empty((len(order), len(norm))), np.empty((len(order), len(norm)))
        for i, k in enumerate(order):
            if i == 0:
                need = np.ones(len(norm), dtype=bool)  # the root is scored against all
            else:
                p, reach = at[parent[k]], edge[k] * norm
                np.subtract(low[p], reach + slack, out=low[i])
                np.add(high[p], reach + slack, out=high[i])
                need = np.zeros(len(norm), dtype=bool)
                for w in windows[k]:
                    need |= (high[i] >= w.low) & (low[i] <= w.high)
                need &= ((c["label"] == anchors["label"][k]) == same) & (c["row"] != anchors["row"][k])
            hit = np.flatnonzero(need)
            if not len(hit):
                continue
            s = _products(xc if len(hit) == len(norm) else xc[hit], a[k])
            scored += len(hit)
            low[i, hit] = high[i, hit] = s
            fit = ((c["label"][hit] == anchors["label"][k]) == same) & (c["row"][hit] != anchors["row"][k])
            s, ids = s[fit], c["vec_id"][hit][fit]
            for w in windows[k]:
                w.add(s, ids)
    return scored


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    out = {c: t[c].to_numpy() for c in ("row", "vec_id", "label")}
    flat = t["x"].combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(flat.chunks).flatten()
    return out | {"x": flat.to_numpy().reshape(len(t), -1)}


def _deal(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int):
    """Rows and anchors cogrouped as (length, shard, block)."""

    def dealt(df, own, n_own, other, n_other):
        return (df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
                .groupBy(F.size("x").alias("d"), "shard", "block"))

    return dealt(rows, "shard", shards, "block", blocks).cogroup(dealt(anchors, "block", blocks, "shard", shards))


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of every key by score and id, ranked."""
    near = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def labelled(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, label, x)`` of the rows that take part, written."""
    v = vectors.where(sound() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled().alias("x"))
    return materialize(v.select(F.monotonically_increasing_id().alias("row"), "*"), "labelled-vectors")


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)`` for the anchors among ``rows(row, vec_id, label, x)``."""
    ship(rows.sparkSession)
    anchors = materialize(rows.where(F.coalesce(is_anchor, F.lit(False))), "anchors")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-rows.count() // SHARD_ROWS), least)
    blocks = max(-(-anchors.count() // BLOCK_ANCHORS), 1)

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        own: list[list[Best]] = [[Best(-_TOP, _TOP, POSITIVES)] for _ in range(len(right))]
        a = _arrays(right) if len(right) else {}
        if len(left) and len(right):
            search(_arrays(left), a, own, True)
        return _table([(int(a["row"][i]), int(v), int(s)) for i, (w,) in enumerate(own) for v, s in zip(w.id, w.score)],
                      ["anchor", "vec_id", "score"])

    found = _deal(rows, anchors, shards, blocks).applyInArrow(positives, "anchor long, vec_id long, score long")
    pairs = materialize(_first(found, ["anchor"], POSITIVES), "positives")
    lists = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    asked = materialize(anchors.join(lists.withColumnRenamed("anchor", "row"), "row"), "anchors-with-positives")

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            a, pos = _arrays(right), right["positives"].to_pylist()
            own = [[Best(-(-LOW * p["score"] // 100), HIGH * p["score"] // 100, NEGATIVES) for p in ps] for ps in pos]
            search(_arrays(left), a, own, False)
            out = [(int(a["row"][i]), int(a["vec_id"][i]), p["rank"], p["vec_id"], p["score"], int(v), int(s))
                   for i, ps in enumerate(pos) for p, w in zip(ps, own[i]) for v, s in zip(w.id, w.score)]
        return _table(out, ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "vec_id", "score"])

    found = _deal(rows, asked, shards, blocks).applyInArrow(
        negatives, "anchor long, anchor_id long, positive long, positive_id long, positive_score long, vec_id long, score long")
    return _first(found, ["anchor", "positive"], NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)
