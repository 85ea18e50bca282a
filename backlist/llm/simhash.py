"""SimHash near-duplicates: segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is cut into 32 segments of two bits.  Its embedding
holds each segment's bit count (0, 1 or 2) in thermometer form (00, 01, 11),
so the Manhattan distance of two embeddings is the popcount of their XOR, and
it never exceeds the Hamming distance of the fingerprints.  The grid has
2 * d blocks of segments; within Manhattan distance d at least d blocks
agree in every coordinate, so each choice of d blocks is one family of unit
cells and the range join is an equality join on (family, cell).  Pairs of a
cell pass the Manhattan bound first and the exact bit distance second.

Work is on distinct fingerprints (copies are grouped before any shuffle of
pairs).  Inside a cell only a spanning forest of its links leaves the task,
and a cell with more than ``CELL_ROWS`` fingerprints is dealt out as pairs of
hashed sub-blocks, so no task sees an unbounded group and no link is lost.

Defined cases: null or blank text has fingerprint zero and is linked like any
other; fewer words than the shingle length make one shingle; very long texts
are read whole; repeated doc_ids give one row each, and of rows with one id the
first by hash counts as a group's first; null doc_ids take part and yield to
any id as component id; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, materialize
from backlist.llm.components import connected_components

CELL_ROWS = 2048
SEED = 42
_LOW = 0x5555555555555555


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        digests = h(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends.tolist()]
        digests = b"".join([h(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())])
    each = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(each), 1 << 16):
        ones += np.unpackbits(each[lo:lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(each)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, u1, u2, fp)`` of every row; u1 and u2 identify the row by
    hashes of id and text, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            fp = np.array([fingerprint(t, shingle) for t in encoded(b.column(3))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], ["doc_id", "u1", "u2", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), *_identity(), "text"), run,
                     "doc_id long, u1 long, u2 long, fp long")


def _identity():
    return F.xxhash64("doc_id", "text").alias("u1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("u2")


def embedding(fp):
    """Thermometer form of the bit counts of all two-bit segments."""
    low, high = fp.bitwiseAND(_LOW), F.shiftrightunsigned(fp, 1).bitwiseAND(_LOW)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _families(distance: int) -> list[int]:
    edges = [32 * k // (2 * distance) for k in range(2 * distance + 1)]
    block = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the smallest node each one reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _links(cell: np.ndarray, fp: np.ndarray, emb: np.ndarray, part: np.ndarray, cross: np.ndarray,
           distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows of whole cells (equal ``cell``, adjacent)."""
    at, step, found = np.arange(len(fp)), 0, []
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        near = np.bitwise_count(emb[at] ^ emb[at + step]) <= distance
        near &= ~cross[at] | (part[at] != part[at + step])
        i = at[near]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        found.append(np.stack([i, i + step]))
        if sum(x.shape[1] for x in found) > 1 << 20:  # keep a forest of the links so far
            a, b = np.concatenate(found, axis=1)
            root = _forest(len(fp), a, b)
            k = np.flatnonzero(root != np.arange(len(fp)))
            found = [np.stack([k, root[k]])]
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=int)
    root = _forest(len(fp), a, b)
    k = np.flatnonzero(root != np.arange(len(fp)))
    return fp[k], fp[root[k]]


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``(a, b)``: links that connect what pairs of distinct ``fp`` within
    ``distance`` bits connect."""
    fam = F.array(*[F.struct(F.lit(k).alias("family"), F.col("emb").bitwiseAND(F.lit(_signed(m))).alias("cell"))
                    for k, m in enumerate(_families(distance))])
    cells = (fps.select("fp", embedding(F.col("fp")).alias("emb"))
             .select("fp", "emb", F.explode(fam).alias("c")).select("fp", "emb", "c.family", "c.cell"))
    large = (cells.groupBy("family", "cell").count().where(F.col("count") > CELL_ROWS)
             .select("family", "cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts")))
    n = F.coalesce("parts", F.lit(1))
    dealt = (cells.join(large, ["family", "cell"], "left")
             .select("fp", "emb", "family", "cell", n.alias("n"),
                     F.pmod(F.xxhash64("fp", "family"), n).cast("int").alias("part"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
             .select("fp", "emb", "family", "cell", "part", F.least("part", "other").alias("i"),
                     F.greatest("part", "other").alias("j")))
    key = ["family", "cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(cols):
            k = np.stack(cols[3:])
            cell = np.concatenate([[0], np.cumsum((k[:, 1:] != k[:, :-1]).any(axis=0))])
            a, b = _links(cell, cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[5] != cols[6], distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.ones(len(cols[0]), dtype=bool)  # rows of the last group, which the next batch may go on with
            for c in cols[3:]:
                last &= c == c[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield out([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held:
            yield out(held)

    return map_arrow(dealt.select("fp", "emb", "part", *key).repartition(*key).sortWithinPartitions(*key),
                     run, "a long, b long")


def _groups(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and ``(fp, first)``: the first row of the
    group that each fingerprint is linked to, by id (nulls last)."""
    each = materialize(fingerprints(docs, shingle), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "u1", "u2")
    fps = materialize(each.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    comp = connected_components(links(fps, distance))
    rooted = fps.join(comp, fps.fp == comp.a, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    # written, so that a large component's rows can be split in the join
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "simhash-firsts")
    return each, rooted.select("fp", "root").join(least, "root").select("fp", "root", "first")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` of every row of ``docs``;
    component_id is the smallest doc_id that links reach."""
    each, groups = _groups(docs, shingle, distance)
    return (each.join(groups, "fp")
            .select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("first.doc_id").alias("component_id")))


def keep_first(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The first row of each group (least doc_id, nulls last), with all columns;
    of equal rows one stays."""
    _, groups = _groups(docs, shingle, distance)
    first = groups.select("first.u1", "first.u2").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_identity())
    return (rows.join(first, ["u1", "u2"], "left_semi").groupBy("u1", "u2").agg(F.first("row").alias("row"))
            .select("row.*"))
