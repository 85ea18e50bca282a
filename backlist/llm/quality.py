"""Quality by importance resampling of hashed n-grams (target against raw).

Two generative models, bags of hashed word unigrams and bigrams, are counted:
one over labelled good documents, one over all documents.  A document's log
importance weight is the sum over its n-grams of the log ratio of the two;
Gumbel noise drawn from its id is added and the top k documents are kept:
sampling without replacement in proportion to the weights.  k is the share
of good documents among the labelled ones and a reserve of ``RESERVE``, times
the number of documents: the border falls among the bad, not the good.

The target model is fitted on at most ``TARGET_ROWS`` labelled documents
(those whose ids hash lowest); the raw model counts every document.

Defined cases: null and blank texts have weight zero; of rows with equal keys
at the threshold all are kept; repeated doc_ids are scored row by row; labels
that contradict each other count as good; without labelled rows, or without
documents, everything is kept; other columns are ignored or handed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, materialize, mix, word_hashes, word_spans

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
RESERVE = 0.02
NOISE_SEED = 1_234_567


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, document, words of each document)`` of all word unigrams and
    bigrams (ASCII letters in lower case)."""
    buf, start, end, first = word_spans([t.lower() for t in texts])
    h = word_hashes(buf, start, end)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    same = doc[1:] == doc[:-1]
    two = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    bucket = np.concatenate([h, two]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.concatenate([doc, doc[:-1][same]]), np.diff(first)


def log_ratio(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket under the two models, and the share of good
    documents among labelled ones."""
    judged = (labels.where("doc_id is not null and quality is not null")
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("good")))
    seen, good = judged.agg(F.count(F.lit(1)), F.sum((F.col("good") == 1).cast("int"))).first()
    target = (judged.where("good = 1").orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
              .select("id", F.lit(True).alias("target")))
    # at most TARGET_ROWS rows
    flagged = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(target), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in blocks(batches, "text"):
            bucket, doc, _ = features(encoded(b.column(0)))
            is_target = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            n[0] += np.bincount(bucket, minlength=BUCKETS)
            n[1] += np.bincount(bucket[is_target[doc]], minlength=BUCKETS)
        k = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, n[0][k], n[1][k])], ["bucket", "raw", "target"])

    counts = (map_arrow(flagged.select("text", "target"), run, "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    n = np.zeros((2, BUCKETS))
    for r in counts.collect():  # at most BUCKETS rows
        n[:, r["bucket"]] = r["raw"], r["target"]
    if not seen or not good or not n[1].sum():
        return np.zeros(BUCKETS), 1.0
    p = (n + 1) / (n.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(p[1] / p[0]), good / seen


def _keys(ids: pa.Array, texts: list[bytes], ratio: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(words, log weight, score, key)``: score is the weight with Gumbel
    noise, key is score as a long of the same order."""
    bucket, doc, words = features(texts)
    weight = np.bincount(doc, weights=ratio[bucket], minlength=len(texts)) if len(doc) else np.zeros(len(texts))
    i = np.asarray(ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)).view(np.uint64)
    u = (mix(mix(i + np.uint64(NOISE_SEED)) ^ np.uint64(NOISE_SEED)) >> np.uint64(11)).astype(np.float64)
    score = weight - np.log(-np.log((u + 0.5) * 2.0 ** -53)) + 0.0
    bits = score.view(np.int64)
    return words, weight, score, bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, log_weight, score, key)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            cols = _keys(b.column(0), encoded(b.column(1)), ratio)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)],
                                             ["doc_id", "n_words", "log_weight", "score", "key"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_words long, log_weight double, score double, key long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of ``keys(key long)``, by counting 16 bits at a time:
    no sort, at most 65,536 counts on the driver.  None: fewer than k rows."""
    high = None
    for shift in (48, 32, 16, 0):
        level = keys if high is None else keys.where(F.shiftright("key", shift + 16) == high)
        n = {r["p"]: r["n"] for r in level.groupBy(F.shiftright("key", shift).alias("p"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
        for p in sorted(n, reverse=True):
            if k <= n[p]:
                high = p
                break
            k -= n[p]
        else:
            return None
    return high


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, n_words, log_weight, score, selected)`` of every row."""
    ratio, share = log_ratio(docs, labels)
    each = materialize(scores(docs, ratio), "quality")
    least = threshold(each, share)
    return each.select("doc_id", "n_words", "log_weight", "score", (F.col("key") >= F.lit(least)).alias("selected"))


def threshold(each: DataFrame, share: float) -> int:
    least = None
    if share + RESERVE < 1:
        least = kth_largest(each.select("key"), max(1, round((share + RESERVE) * each.count())))
    return -(1 << 63) if least is None else least


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the resampling selects, with all their columns."""
    ratio, share = log_ratio(docs, labels)
    least = threshold(materialize(scores(docs, ratio), "quality"), share)
    at = [docs.columns.index("doc_id"), docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            key = _keys(b.column(at[0]), encoded(b.column(at[1])), ratio)[3]
            yield b.filter(pa.array(key >= least))

    return map_arrow(docs, run, docs.schema)
