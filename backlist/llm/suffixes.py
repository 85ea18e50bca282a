"""Suffix-array deduplication of byte strings.

Every byte covered by a ``LENGTH``-byte string that also starts earlier is
removed.  Texts are bytes of UTF-8; matches never cross documents.

Screen, which loses nothing: each ``LENGTH``-byte window has an anchor, the
least hash of its ``GRAM``-byte runs.  Equal windows have equal anchors, so a
window whose anchor stands at one place alone is unique.  Consecutive windows
with one anchor make a segment.  Equal segments are counted first: all but the
earliest one go whole.  What is left to compare are the distinct segments whose
anchor occurs in another distinct one, or twice in the same.

Suffix array: the suffixes at these anchors are range-partitioned by their
leading bytes.  The splitters are keys of a random sample; a key ends with a
hash of the whole segment, so that keys differ and a splitter can cut any run
of equal suffixes.  Each bucket sorts all suffixes that start at its segments'
windows by multikey quicksort over 8-byte keys; runs that agree in ``LENGTH``
bytes are equal windows, and all but the earliest of a run go.  Windows whose
bytes from the anchor on agree with one of the bucket's splitters may have
equals beyond it: the earliest of each such run is compared across the
boundaries.  Beyond ``RANGES`` ranges, segments are also dealt by their
anchor's hash, so buckets don't grow with the corpus; only the buckets of one
anchor with more than a range's share of distinct segments do.

Order of places: doc_id, then (for rows of one id) a hash of the row, then the
start.  Defined cases: null and empty texts have no bytes; texts shorter than
the string lose nothing; very long texts are one row like any other; rows equal
in id and text are one document, and each gets that document's result; null
doc_ids come last, ordered by hash; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import _P_INV, _T, _powers, _prefix, blocks, encoded, map_arrow, materialize, mix

LENGTH = 100
GRAM = 38
RUN = LENGTH - GRAM + 1  # grams in a window, and the most windows in a segment
BUCKET_BYTES = 4 << 20  # segments' bytes in a bucket
RANGES, KEYS_EACH = 10_000, 20  # most ranges, and sampled keys for each
_LAST = (1 << 63) - 1
_KEY = ["doc", "u"]


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix sums of a block and the hash of the gram at each byte."""
    prefix, n = _prefix(_T[buf]), max(len(buf) - GRAM + 1, 0)
    return prefix, _mixed((prefix[GRAM:] - prefix[:-GRAM])[:n] * _powers(_P_INV, len(buf) + 1, "inv")[:n])


def cut_segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(text, place, anchor, hash of the bytes)`` of every segment; place packs
    the first window's start, whether the anchor stands in it twice, and the
    number of windows."""
    none = np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    windows = np.maximum(size - LENGTH + 1, 0)
    if not windows.any():
        return none, none, none, none
    begin = np.cumsum(size) - size
    prefix, gram = _grams(np.frombuffer(b"".join(texts), dtype=np.uint8))
    least, width = gram, 1  # least gram of `width` in a row, by doubling
    while 2 * width <= RUN:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:len(least) - (RUN - width)], least[RUN - width:])
    doc = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(doc)) + np.repeat(begin - np.cumsum(windows) + windows, windows)
    least = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    new |= (np.arange(len(at)) - start[np.cumsum(new) - 1]) % RUN == 0
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(at)))
    w, d, anchor = at[start], doc[start], least[start]
    spans = n + RUN - 1  # grams of each segment
    spot = np.repeat(w - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
    again = np.add.reduceat(gram[spot] == np.repeat(anchor, spans), np.cumsum(spans) - spans, dtype=np.int64) > 1
    end = w + n + LENGTH - 1
    content = mix((prefix[end] - prefix[w]) * _powers(_P_INV, len(prefix) + 1, "inv")[w] + n.astype(np.uint64))
    return d, (w - begin[d]) << 7 | again << 6 | n, anchor.view(np.int64), content.view(np.int64)


def pieces(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, first window, windows, the anchor's place from there)``: the
    runs of windows in which the anchor's first place is one and the same."""
    size = np.array([len(s) for s in segments], dtype=np.int64)
    begin = np.cumsum(size) - size
    _, gram = _grams(np.frombuffer(b"".join(segments), dtype=np.uint8))
    n = size - GRAM + 1
    spot = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    seg = np.repeat(np.arange(len(segments)), n)
    gram = gram[spot]
    hit = np.flatnonzero(gram == np.minimum.reduceat(gram, np.cumsum(n) - n)[seg])
    seg, place = seg[hit], spot[hit] - begin[seg[hit]]
    first = np.zeros(len(hit), dtype=np.int64)
    same = seg[1:] == seg[:-1]
    first[1:][same] = place[:-1][same] + 1
    last = np.minimum(place, size[seg] - LENGTH)
    some = first <= last
    seg, first, last, place = seg[some], first[some], last[some], place[some]
    return seg, first, last - first + 1, place - first


def multikey_groups(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of each suffix's class of equal first ``LENGTH`` bytes, -1 for
    suffixes that are alone; suffixes are split on eight bytes at a time, and
    only those still tied go on."""
    words = np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf.tobytes(), strides=(1,))
    out = np.full(len(starts), -1, dtype=np.int64)
    at, group = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for depth in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        key = words[starts[at] + depth].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        at, key, old = at[order], key[order], group[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        alone = head & np.append(head[1:], True)
        at, group = at[~alone], (np.cumsum(head) - 1)[~alone]
        if not len(at):
            return out
    out[at] = group
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def sort_bucket(texts: list[bytes], anchors: list[int], rank: np.ndarray, start: np.ndarray,
                low: bytes | None, high: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """``(mask, open)`` of each piece: bits of the windows that stand earlier in
    the bucket, and of those that are first here but share with a splitter all
    that they have from the anchor on.

    ``rank`` orders the pieces' documents, ``start`` is a piece's place there."""
    size = np.array([len(s) for s in texts], dtype=np.int64)
    n, begin = size - LENGTH + 1, np.cumsum(size) - size
    buf = np.frombuffer(b"".join(texts) + b"\0" * 8, dtype=np.uint8)
    piece = np.repeat(np.arange(len(texts)), n)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    group = multikey_groups(buf, begin[piece] + off)
    tied = np.flatnonzero(group >= 0)
    # a class in the order of its places: all but the first go
    tied = tied[np.lexsort((start[piece[tied]] + off[tied], rank[piece[tied]], group[tied]))]
    later = tied[1:][group[tied[1:]] == group[tied[:-1]]]
    mask, open_ = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    np.bitwise_or.at(mask, piece[later], np.int64(1) << off[later])
    ends = [x for x in (low, high) if x is not None and len(x) > GRAM]  # others part no suffixes that share a gram
    for k, (text, a) in enumerate(zip(texts, anchors)):
        common = max((_common(text[a:a + LENGTH], x) for x in ends), default=0)
        # a window that starts j bytes before the anchor has LENGTH - j bytes from there on
        if common >= GRAM:
            open_[k] = sum(1 << w for w in range(int(n[k])) if LENGTH - (a - w) <= common and not int(mask[k]) >> w & 1)
    return mask, open_


def _identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, doc, u)``: doc and u name and order the rows."""
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), "text", F.coalesce(key, F.lit(_LAST)).alias("doc"),
                       F.xxhash64(key, F.lit(1), "text").alias("u"))


def _squeezed(rows: DataFrame) -> DataFrame:
    """``(doc_id, z, doc, u)`` with the compressed text: smaller shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([z.compress(t) for t in encoded(b.column(1))], pa.binary()), b.column(2), b.column(3)],
                ["doc_id", "z", "doc", "u"])

    return map_arrow(rows, run, "doc_id long, z binary, doc long, u long")


def _anchor_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            _, place, anchor, _ = cut_segments(encoded(b.column(0)))
            anchor, at = np.unique(np.repeat(anchor, 1 + (place >> 6 & 1)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(at)], ["anchor", "n"])

    return map_arrow(rows.select("text"), run, "anchor long, n long")


def segments(rows: DataFrame) -> DataFrame:
    """``(anchor, content, doc, u, place)`` of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            d, place, anchor, content = cut_segments(encoded(b.column(0)))
            doc, u = (b.column(k).to_numpy()[d] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, content, doc, u, place)],
                                             ["anchor", "content", *_KEY, "place"])

    return map_arrow(rows.select("text", *_KEY), run, "anchor long, content long, doc long, u long, place long")


PIECE = "anchor long, content long, doc long, u long, start long, first int"  # first: the piece's first window


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _key(text: bytes, at: int, content: int, first: int) -> bytes:
    """What a piece is ordered by: its suffix at the anchor, then what tells it
    from all others."""
    return text[at:at + LENGTH] + content.to_bytes(8, "big", signed=True) + bytes([first])


def suffixes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pieces of the wanted segments with their bytes and where the anchor
    stands in them."""
    lists = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "content", "place")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("anchor", "content", *_KEY, "start")), ("first", pa.int32()),
                            ("at", pa.int32()), ("bytes", pa.binary())])
        z = zstandard.ZstdDecompressor()

        def cut(own: list[tuple], data: list[bytes]) -> Iterator[pa.RecordBatch]:
            out = []
            for k, w, n, a in zip(*(x.tolist() for x in pieces(data))):
                anchor, content, doc, u, start = own[k]
                text = data[k][w:w + n + LENGTH - 1]
                out.append((anchor, content, doc, u, start + w, w, a, text))
            yield from _batches(out, schema)

        for b in batches:
            own, data = [], []
            for doc, u, packed, segs in zip(*(c.to_pylist() for c in b.columns)):
                text = z.decompress(packed)
                for s in segs:
                    w, n = s["place"] >> 7, s["place"] & 63
                    own.append((s["anchor"], s["content"], doc, u, w))
                    data.append(text[w:w + n + LENGTH - 1])
                if len(data) >= 10_000:
                    yield from cut(own, data)
                    own, data = [], []
            if data:
                yield from cut(own, data)

    # equal rows are one document; they are combined before the shuffle
    texts = _squeezed(rows).groupBy(*_KEY).agg(F.min("z").alias("z"))
    joined = texts.join(lists, _KEY).select(*_KEY, "z", "s")
    return map_arrow(joined, run, f"{PIECE}, at int, bytes binary")


def splitters(keyed: DataFrame) -> tuple[list[bytes], int]:
    """``(keys, planes)``: keys of a random sample that cut the suffixes into
    ranges of equal size, and into how many planes by the anchor's hash they are
    dealt besides, so that a bucket has about ``BUCKET_BYTES``."""
    rows, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()
    buckets = max(-(-size // BUCKET_BYTES), 1)
    ranges = min(buckets, RANGES)
    # drawn by hash, so that a repeated task draws the same rows
    share = min(1.0, ranges * KEYS_EACH / max(rows, 1))
    drawn = keyed.where(F.pmod(F.xxhash64("content", "first"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    keys = sorted(_key(bytes(r["bytes"]), r["at"], r["content"], r["first"])
                  for r in drawn.select("bytes", "at", "content", "first").collect())
    cuts: list[bytes] = []
    for k in sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)} if keys else ()):
        # before all suffixes with these leading bytes; only one that holds
        # more than a bucket's share is cut inside
        cuts.append(k if cuts and cuts[-1][:GRAM] == k[:GRAM] else k[:GRAM])
    return cuts, -(-buckets // ranges)


def compare(keyed: DataFrame) -> DataFrame:
    """``(anchor, content, mask)`` of the segments with windows that stand
    earlier in another one or in the same."""
    cuts, planes = splitters(keyed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (b.column(b.schema.names.index(c)).to_pylist() for c in ("bytes", "at", "content", "first"))
            at = [bisect.bisect_right(cuts, _key(*x)) for x in zip(*own)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "range"])

    def sort(t: pa.Table) -> pa.Table:
        doc, u, start, first = (t[c].to_numpy() for c in (*_KEY, "start", "first"))
        order = np.lexsort((u, doc))
        rank = np.empty(len(doc), dtype=np.int64)
        rank[order] = np.cumsum(np.append(False, (np.diff(doc[order]) != 0) | (np.diff(u[order]) != 0)))
        data, k = t["bytes"].to_pylist(), t["range"][0].as_py()
        mask, open_ = sort_bucket(data, t["at"].to_pylist(), rank, start, cuts[k - 1] if k else None,
                                  cuts[k] if k < len(cuts) else None)
        out = t.select(["anchor", "content", *_KEY, "start", "first"]).append_column("mask", pa.array(mask << first))
        out = out.append_column("open", pa.array(open_))
        out = out.append_column("bytes", pa.array([s if o else None for s, o in zip(data, open_.tolist())], pa.binary()))
        return out.filter(pa.array((mask != 0) | (open_ != 0)))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("anchor", "content", *_KEY, "start", "mask")), ("window", pa.binary())])
        for b in batches:
            for k in range(0, b.num_rows, 500):
                yield from _batches([(r["anchor"], r["content"], r["doc"], r["u"], r["start"] + w, 1 << r["first"] + w,
                                      r["bytes"][w:w + LENGTH])
                                     for r in b.slice(k, 500).to_pylist() for w in range(RUN) if r["open"] >> w & 1], schema)

    dealt = map_arrow(keyed, deal, f"{PIECE}, at int, bytes binary, range int")
    plane = F.pmod("anchor", F.lit(planes)).alias("plane")
    sorted_ = materialize(dealt.groupBy("range", plane).applyInArrow(sort, f"{PIECE}, mask long, open long, bytes binary"), "buckets")
    # across the boundaries: each bucket's earliest of every class that a splitter may part
    edge = materialize(map_arrow(sorted_.where("open <> 0"), expand, "anchor long, content long, doc long, u long, "
                                 "start long, mask long, window binary"), "boundaries")
    place = F.struct(*_KEY, "start")
    first = materialize(edge.groupBy("window").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").drop("n"), "boundary-firsts")
    beyond = edge.join(first, "window").where(place > F.col("earliest")).select("anchor", "content", "mask")
    return (sorted_.where("mask <> 0").select("anchor", "content", "mask").unionByName(beyond)
            .groupBy("anchor", "content").agg(F.bit_or("mask").alias("mask")))


def marks(docs: DataFrame) -> DataFrame:
    """``(doc, u, hits)``: the segments of each document that hold windows which
    also stand earlier, ``array<struct<place, mask>>``."""
    rows = _identified(docs)
    twice = _anchor_counts(rows).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    # tables that are joined are written, so that both sides of a join come
    # straight from a shuffle and a hot anchor's rows can be split
    some = materialize(segments(rows).join(materialize(twice, "anchors"), "anchor"), "repeated-anchors")
    place = F.col("place")
    distinct = materialize(some.groupBy("anchor", "content").agg(F.min(F.struct(*_KEY, "place")).alias("at"))
                           .select("anchor", "content", "at.*"), "distinct-segments")
    several = (distinct.groupBy("anchor").agg(F.sum(F.lit(1) + (place.bitwiseAND(64) / 64).cast("int")).alias("n"))
               .where("n > 1").select("anchor"))
    wanted = distinct.join(materialize(several, "several"), "anchor")
    keyed = materialize(suffixes(rows, wanted), "suffixes")
    firsts = materialize(distinct.join(compare(keyed), ["anchor", "content"], "left")
                         .select("anchor", "content", F.struct(*_KEY, "place").alias("first"),
                                 F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "first-segments")
    full = F.expr("shiftrightunsigned(-1L, 64 - cast(place & 63 as int))")
    hits = some.join(firsts, ["anchor", "content"]).select(
        *_KEY, "place", F.when(F.struct(*_KEY, "place") == F.col("first"), F.col("mask")).otherwise(full).alias("mask"))
    return hits.where("mask <> 0").groupBy(*_KEY).agg(F.collect_set(F.struct("place", "mask")).alias("hits"))


def removed_spans(hits: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of bytes that marked windows cover, in order."""
    runs = []
    for hit in hits or ():
        w, mask = hit["place"] >> 7, hit["mask"]
        while mask:  # runs of ones
            low = (mask & -mask).bit_length() - 1
            ones = ((mask >> low) + 1 & -((mask >> low) + 1)).bit_length() - 1
            runs.append((w + low, w + low + ones - 1 + LENGTH))
            mask = mask >> low + ones << low + ones
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, spans)`` of every row: kept
    are the remaining bytes, spans the removed runs ``(start, end)``."""
    found = materialize(marks(docs), "marks")
    joined = _squeezed(_identified(docs)).join(found, _KEY, "left").select("doc_id", "z", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, out = b.slice(k, 256), []
                for packed, hits in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text, spans = z.decompress(packed), removed_spans(hits)
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[lo:hi] for lo, hi in zip(edges[::2], edges[1::2]))
                    out.append((len(text), len(text) - len(kept), len(spans), kept, [{"start": a, "end": e} for a, e in spans]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), span]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, x) for c, x in zip(zip(*out), kinds))],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
                                  "spans array<struct<start: bigint, end: bigint>>")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
