"""Queries of the training-data operators, over whole tables, with their
production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backlist.llm import (decontaminate, forest, langid, negatives, packing, quality, simhash, substring, suffixes,
                          toxicity, warc, whitening, wordpiece)
from backlist.llm.common import table

# Parameters that the contracts fix.
PACK = {"path": public_tokenizers.path("word_bpe_49k.json"), "end_id": 2, "length": 4096}
SIMHASH = {"shingle": 3, "distance": 3}
PIECES = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), **PACK)


def op2_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring.repeated(table(spark, d, "documents"))


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"), **SIMHASH).select("doc_id", "fingerprint", "component_id")


def op6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, d, "documents"), PIECES)


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


def op8_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.resample(table(spark, d, "documents"), table(spark, d, "labels"))


def op10_ann_forest(spark: SparkSession, d: str) -> DataFrame:
    return forest.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.digests(table(spark, d, "documents"))


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.labelled(table(spark, d, "embeddings").withColumn("label", label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_packing, op2_substring_dedup, op3_toxicity, op4_decontamination, op5_simhash, op6_token_counts,
    op7_language_id, op8_warc, op9_quality, op10_ann_forest, op11_suffix_dedup, op12_whitening, op13_hard_negatives)}

ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM docs),
win AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER
    (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS seq, n FROM each),
full_win AS (SELECT doc_id, pos, md5(seq) AS seq FROM win WHERE pos + 34 <= n),
hit AS (SELECT doc_id, pos FROM full_win WHERE seq IN (SELECT seq FROM full_win GROUP BY seq HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hit, range(35) r(k)),
kept AS (
  SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY e.pos) AS txt
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)),
    '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM q""",
    "op11_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
n AS (SELECT doc_id, hx, strlen(hx) // 2 AS nb FROM d),
p AS (SELECT doc_id, nb, o, substr(hx, 2 * o + 1, 2198) AS s FROM (SELECT *, unnest(range(0, nb, 1000)) AS o FROM n)),
w AS (
  SELECT doc_id, o + k AS pos, md5(substr(s, 2 * k + 1, 200)) AS h
  FROM (SELECT *, unnest(range(1000)) AS k FROM p) WHERE o + k + 100 <= nb),
hit AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1),
edge AS (
  SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM edge),
span AS (SELECT doc_id, min(pos) AS lo, max(pos) + 100 AS hi FROM run GROUP BY doc_id, g),
spans AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his
  FROM span GROUP BY doc_id),
kept AS (
  SELECT n.doc_id, nb, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    array_to_string(list_transform(range(1, coalesce(n_spans, 0) + 2), lambda i: substr(hx,
      CAST(2 * list_extract(list_concat([0], coalesce(his, [])), i) + 1 AS BIGINT),
      CAST(2 * (list_extract(list_concat(coalesce(los, []), [nb]), i) - list_extract(list_concat([0], coalesce(his, [])), i)) AS BIGINT))),
      '') AS rest
  FROM n LEFT JOIN spans ON n.doc_id = spans.doc_id)
SELECT doc_id, CAST(nb AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(rest)) AS kept_sha256
FROM kept""",
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.x) = len(v.x)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
m AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM m WHERE rank <= 10""",
}
