"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised, cut into pieces of at most the sequence length, and
the histogram of piece lengths (at most one row per possible length, whatever
the number of documents) is packed: lengths longest first, each into the
packs that are shortest so far and still have room.  Packs of equal content
are one pattern with a count, so the packing works on patterns, never on
documents.  Patterns are then joined back to pieces by rank: the r-th piece
of a length takes the r-th place that the patterns hold for this length.

Defined cases: a null or empty text is one piece with the end id alone; a very
long text is cut into pieces of the sequence length and a rest; pieces of equal
length are interchangeable and take their places in the order in which the
tasks cut them; repeated rows and doc_ids are packed row by row;
null doc_ids stay null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, materialize, word_hashes
from backlist.llm.text import HashIndex, units

KNOWN_UNITS = 1_000_000  # units of text whose ids a worker remembers before it starts anew

class _Tokens:
    """Ids of units of text, kept for units seen lately."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = HashIndex()
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        lists = [e.ids for lo in range(0, len(words), 1 << 14)
                 for e in self.tok.encode_batch_fast(words[lo:lo + (1 << 14)], add_special_tokens=False)]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], dtype="<u4")])
        self.known.add(hashes)


_LOADED: dict[str, _Tokens] = {}


def token_ids(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Each text's ids (little-endian unsigned 32-bit numbers)."""
    if path not in _LOADED:
        _LOADED[path] = _Tokens(path)
    known = _LOADED[path]
    buf, start, end, first = units(texts)
    h = word_hashes(buf, start, end)
    data = buf.tobytes()

    def learn(new, at):
        known.learn(new, [data[s:e].decode() for s, e in zip(start[at].tolist(), end[at].tolist())])

    def clear():
        known.clear()
        return known.known

    k = known.known.find_or_learn(h, KNOWN_UNITS, learn, clear)
    size = known.size[k]
    total = np.cumsum(size)
    ids = known.ids[np.repeat(known.at[k] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
    bound = np.append(0, total)[first]
    return [ids[a:b] for a, b in zip(bound[:-1], bound[1:])]


def cut(docs: DataFrame, path: str, end_id: int, length: int) -> DataFrame:
    """``(bucket, rank, doc_id, start, length, ids_crc32, doc_tokens)``: every
    document's ids with the end id, cut into pieces of ``length`` and a rest.
    ``rank`` counts the pieces of the same length in the task ``bucket``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        ranks = np.zeros(length + 1, dtype=np.int64)
        for b in blocks(batches):
            ids, rows = b.column(0).to_pylist(), []
            for doc_id, each in zip(ids, token_ids(encoded(b.column(1)), path)):
                data = each.tobytes() + end
                n = len(data) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    rows.append((doc_id, start, size, zlib.crc32(data[4 * start:4 * (start + size)]), n, int(ranks[size])))
                    ranks[size] += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in cols]],
                ["bucket", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"])

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "bucket int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long")


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(packs, [(length, copies), ...])`` that hold all lengths."""
    heap: list[tuple[int, int, int, tuple]] = []  # (-room, age, packs, pattern); a pattern is (length, copies, rest)
    age = 0

    def put(room, packs, pattern):
        nonlocal age
        if packs:
            age += 1
            heapq.heappush(heap, (-room, age, packs, pattern))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            if heap and -heap[0][0] >= size:
                room, _, packs, pattern = heapq.heappop(heap)
                k = min(left, packs)
                grown = (size, pattern[1] + 1, pattern[2]) if pattern[0] == size else (size, 1, pattern)
                put(-room - size, k, grown)
                put(-room, packs - k, pattern)
                left -= k
            else:
                each = capacity // size
                put(capacity - each * size, left // each, (size, each, None))
                put(capacity - left % each * size, int(left % each > 0), (size, left % each, None))
                left = 0
    out = []
    for _, _, packs, pattern in sorted(heap):
        parts = []
        while pattern:
            parts.append(pattern[:2])
            pattern = pattern[2]
        out.append((packs, parts[::-1]))
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, copies, offset)``, sorted:
    from this rank on, pieces of this length go to these sequences."""
    rows, used, sequence = [], {}, 0
    for packs, parts in patterns:
        offset = 0
        for size, copies in parts:
            rows.append((size, used.get(size, 0), sequence, copies, offset))
            used[size] = used.get(size, 0) + packs * copies
            offset += size * copies
        sequence += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset)``."""
    pieces = materialize(cut(docs, path, end_id, length), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per length: bounded by the sequence length
    hist = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(pack_histogram(hist, length))
    key = table[:, 0] << 44 | table[:, 1]
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (pieces.join(offsets, ["length", "bucket"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("rank")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(k).to_numpy() for k in (2, 5))
            _, first, sequence, copies, offset = table[np.searchsorted(key, size << 44 | rank, side="right") - 1].T
            at = rank - first
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence + at // copies), pa.array(offset + at % copies * size)],
                [*b.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(ranked, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long")
