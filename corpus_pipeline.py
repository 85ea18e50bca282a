"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``docs``.  Substring removal leaves the kept words,
joined by one space, as the text of the documents that lost some.

The stages need a tokenizer, XXH64 and learned weights, which SQL does not
have, so there is no ORACLE_SQL; ``tests/llm/test_pipeline.py`` holds every
stage, and the rows of ``run``, against brute force.

Defined cases, as the operators have them: null and blank texts weigh nothing
in the quality stage, are near duplicates of each other, lose no words, hold no
benchmark passage and become one piece with the end id; very long texts are
read whole; of equal rows one stays, null doc_ids yield to any id; of equal
scores at the quality threshold all stay; an empty table stays empty; further
columns are handed through up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from backlist.llm import decontaminate, packing, quality, simhash, substring
from backlist.llm.common import materialize, table
from backlist.llm.registry import PACK, SIMHASH


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, **SIMHASH)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **PACK)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
