"""Substring deduplication with an FM-index per shard.

A window of ``WINDOW`` words is repeated if its word sequence starts at two
places of the corpus or more.  Every window has an anchor, the least hash of
its ``GRAM``-word runs, so equal windows have equal anchors.  Consecutive
windows with the same anchor make a segment; anchors that stand at one place
alone are dropped,
equal segments are counted, and each distinct one goes with its count to the
shard of its anchor.  A shard builds a compressed FM-index of its segments
and streams them through it: backward search gives matching statistics, and
the runs of at least ``WINDOW`` words that occur twice mark windows.  The
marks are joined back to all segments and documents, and covered words go.

Word runs that are frequent in the corpus would make hot anchors.  They are
counted first (at most ``HOT_GRAMS`` can exceed their share) and come last in
the order of anchors, so a frequent line is keyed by its surroundings, and
what is made of frequent runs alone is copies, which are counted beforehand.

Rows are told apart by 128 bits of hash of id and text, so repeated rows are
documents of their own that repeat each other.

Defined cases: null and blank texts have no words; texts shorter than the
window lose nothing; very long texts are one row like any other; repeated rows
lose every word of every window; null doc_ids are kept apart by text; an empty
table gives an empty result; other columns are ignored or handed through,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, gram_hashes, map_arrow, materialize, word_hashes, word_spans
from backlist.llm.fm_index import FMIndex

WINDOW = 35
GRAM = 8
HOT_GRAMS = 100_000
HOT_COUNT = 64  # never hot below this
SHARD_WORDS = 250_000
BLOCK = 1 << 19  # bytes of text hashed at once
_RUN = WINDOW - GRAM + 1  # grams in a window, and the most windows in a segment
_LATE = np.uint64(1 << 63)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word hashes, first word of each text, hash of the gram at each word)``."""
    buf, start, end, first = word_spans(texts)
    h = word_hashes(buf, start, end)
    lo = np.arange(max(len(h) - GRAM + 1, 0))
    return h, first, gram_hashes(h, lo, lo + GRAM) >> np.uint64(1)


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the grams that hold more than their share of the
    corpus, as far as single blocks of text show it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, max_bytes=BLOCK):
            g = _grams(encoded(b.column(0)))[2]
            gram, n = np.unique(g, return_counts=True)
            keep = n >= max(3, len(g) // (HOT_GRAMS // 5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(gram[keep].view(np.int64), -1)), pa.array(np.append(n[keep], len(g)))], ["gram", "n"])

    counts = materialize(map_arrow(docs.select("text"), run, "gram long, n long")
                         .groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_COUNT), "grams")
    total = counts.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # the counts add up to at most the total, so at most HOT_GRAMS exceed their share
    hot = counts.where((F.col("gram") >= 0) & (F.col("n") > total // HOT_GRAMS)).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in hot], dtype=np.int64).view(np.uint64))


def _segments(texts: list[bytes], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, place, anchor, hash of the words)`` per segment; place packs the
    first word, whether the anchor's gram stands in it twice, and the windows."""
    h, first, g = _grams(texts)
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none
    if len(hot):
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        g = np.where(hot[at] == g, g | _LATE, g)
    least, width = g, 1  # least gram of `width` in a row, by doubling
    while 2 * width <= _RUN:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:len(least) - (_RUN - width)], least[_RUN - width:])
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)[:len(least)]
    word = np.arange(len(least))
    inside = word + WINDOW <= first[1:][doc]  # windows that don't run into the next text
    word, doc, least = word[inside], doc[inside], least[inside]
    if not len(word):
        return none, none, none, none
    new = np.ones(len(word), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    new |= (np.arange(len(word)) - start[np.cumsum(new) - 1]) % _RUN == 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(word)))
    w, d = word[start], doc[start]
    spans = size + _RUN - 1  # grams of each segment
    at = np.repeat(w - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
    again = np.add.reduceat(g[at] == np.repeat(least[start], spans), np.cumsum(spans) - spans, dtype=np.int64) > 1
    content = gram_hashes(h, w, w + size + WINDOW - 1)
    return d, (w - first[d]) << 7 | again << 6 | size, least[start].view(np.int64), content.view(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    """``(row, text, u1, u2)``: all columns but the text as a struct, and the
    row's identity."""
    rest = [docs[c] for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), "text", F.xxhash64("doc_id", "text").alias("u1"),
                       F.xxhash64(F.lit(1), "text", "doc_id").alias("u2"))


def _squeezed(rows: DataFrame) -> DataFrame:
    """The rows with ``z``, the compressed text, in the place of the text:
    smaller shuffles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in blocks(batches):
            k = b.schema.names.index("text")
            packed = pa.array([None if t is None else z.compress(t) for t in b.column(k).cast(pa.binary()).to_pylist()],
                              pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], packed, *b.columns[k + 1:]],
                                             [*b.schema.names[:k], "z", *b.schema.names[k + 1:]])

    kinds = [f"{'z' if f.name == 'text' else f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}"
             for f in rows.schema.fields]
    return map_arrow(rows, run, ", ".join(kinds))


def _text(z: bytes | None) -> bytes:
    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def segments(docs: DataFrame) -> DataFrame:
    """``(anchor, content, u1, u2, place)`` of all segments."""
    hot = frequent_grams(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, max_bytes=BLOCK):
            d, place, anchor, content = _segments(encoded(b.column(0)), hot)
            u1, u2 = (b.column(k).to_numpy()[d] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, content, u1, u2, place)],
                                             ["anchor", "content", "u1", "u2", "place"])

    return map_arrow(_identified(docs).select("text", "u1", "u2"), run,
                     "anchor long, content long, u1 long, u2 long, place long")


def mark_shard(texts: list[bytes], windows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Bit masks of the repeated windows of a shard's distinct segments, each
    given by its words, its number of windows and how often it occurs."""
    buf, start, end, first = word_spans(texts)
    _, number = np.unique(word_hashes(buf, start, end), return_inverse=True)
    n = np.diff(first)
    seg = np.repeat(np.arange(len(texts)), n + 1)
    words = np.zeros(len(seg), dtype=np.int64)
    begin = first[:-1] + np.arange(len(texts))
    words[np.arange(len(number)) + np.repeat(np.arange(len(texts)), n)] = number + 1
    index = FMIndex(words, weight[seg])
    # the longest repeated run that ends with the segment
    mask = np.zeros(len(texts), dtype=np.int64)
    length = index.matching_statistics(begin + n - 1, n)
    tail = np.maximum(length - WINDOW + 1, 0)
    mask |= ((1 << tail) - 1) << (windows - tail)
    # the windows before it, from the first on: a run that fails rules out all
    # windows that hold it and the word before it
    at, left = np.zeros(len(texts), dtype=np.int64), windows - tail
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        got = index.matching_statistics(begin[open_] + at[open_] + WINDOW - 1, np.full(len(open_), WINDOW))
        hit = got == WINDOW
        mask[open_[hit]] |= 1 << at[open_[hit]]
        at[open_] += np.where(hit, 1, WINDOW - got)
        open_ = open_[at[open_] < left[open_]]
    return mask


def marks(docs: DataFrame) -> DataFrame:
    """``(u1, u2, hits)``: the segments of each document that hold repeated
    windows, ``array<struct<place, mask>>``."""
    spark = docs.sparkSession
    each = materialize(segments(docs), "segments")
    twice = each.groupBy("anchor").agg(F.sum((F.col("place").bitwiseAND(64) / 64).cast("int") + 1).alias("n")).where("n > 1").select("anchor")
    # written, so that both sides of the join come straight from a shuffle and
    # the rows of a hot anchor can be split
    some = materialize(each.join(materialize(twice, "anchors"), "anchor"), "repeated-anchors")
    distinct = (some.groupBy("anchor", "content")
                .agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("u1", "u2", "place")).alias("at")))
    distinct = materialize(distinct.select("anchor", "content", "weight", "at.*"), "distinct-segments")
    size = distinct.agg(F.coalesce(F.sum(F.col("place").bitwiseAND(63) + (WINDOW - 1)), F.lit(0))).first()[0]
    shards = max(-(-size // SHARD_WORDS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = distinct.groupBy("u1", "u2").agg(F.collect_list(F.struct("anchor", "content", "weight", "place")).alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, rows = b.slice(lo, 256), []
                for z, segs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = _text(z).split()
                    for s in segs:
                        w, n = s["place"] >> 7, s["place"] & 63
                        rows.append((s["anchor"] % shards, s["anchor"], s["content"], s["weight"], n,
                                     b" ".join(words[w:w + n + WINDOW - 1])))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["shard", "anchor", "content", "weight", "windows", "words"])

    def search(shard: pa.Table) -> pa.Table:
        mask = mark_shard(shard["words"].to_pylist(), shard["windows"].to_numpy(), shard["weight"].to_numpy())
        found = mask != 0
        return shard.select(["anchor", "content"]).append_column("mask", pa.array(mask)).filter(pa.array(found))

    # repeated rows are combined before the shuffle, so a shard gets each segment once
    texts = (_squeezed(_identified(docs).select("text", "u1", "u2")).groupBy("u1", "u2").agg(F.min("z").alias("z"))
             .where(F.col("z").isNotNull()))
    cuts = map_arrow(texts.join(wanted, ["u1", "u2"]).select("z", "s"), cut,
                     "shard long, anchor long, content long, weight long, windows long, words binary")
    found = cuts.groupBy("shard").applyInArrow(search, "anchor long, content long, mask long")
    return (some.join(found, ["anchor", "content"]).groupBy("u1", "u2")
            .agg(F.collect_set(F.struct("place", "mask")).alias("hits")))


def covered(n_words: int, hits: list[dict] | None) -> np.ndarray:
    """Which words repeated windows cover."""
    edge = np.zeros(n_words + WINDOW + 1, dtype=np.int64)
    for hit in hits or ():
        w, n = hit["place"] >> 7, hit["place"] & 63
        for k in range(n):
            if hit["mask"] >> k & 1:
                edge[w + k] += 1
                edge[w + k + WINDOW] -= 1
    return np.cumsum(edge)[:n_words] > 0


def _joined(docs: DataFrame) -> DataFrame:
    found = materialize(marks(docs), "repeated-windows")
    return _squeezed(_identified(docs)).join(found, ["u1", "u2"], "left").select("row", "z", "hits")


def _kept(z: bytes | None, hits: list[dict] | None) -> tuple[bytes, int, int, bytes]:
    """``(text, words, words removed, kept words)``."""
    text = _text(z)
    words = text.split()
    if not hits:
        return text, len(words), 0, b" ".join(words)
    gone = covered(len(words), hits)
    return text, len(words), int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist()) if not x])


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [_kept(z, h)[1:] for z, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                     pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _joined(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "z", "hits")
    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as the text of every
    document that lost some; a numeric column n_chars follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, texts = b.slice(lo, 256), []
                for z, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text, _, removed, kept = _kept(z, h)
                    texts.append(None if z is None else (kept if removed else text).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()),
                                                  pa.array([bool(h) for h in part.column(2).to_pylist()])],
                                                 ["row", "text", "cut"])

    joined = _joined(docs)
    out = map_arrow(joined, run, f"row {joined.schema['row'].dataType.simpleString()}, text string, cut boolean")
    cols = []
    for f in docs.schema.fields:
        c = F.col("text") if f.name == "text" else F.col("row")[f.name]
        if f.name == "n_chars":
            c = F.when(F.col("cut"), F.char_length("text").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return out.select(*cols)
