"""Writers.  Only outputs with a fixed small row bound are coalesced to one
file; datasets are written partitioned and in parallel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from backlist.sources.catalog import Catalog

# quotes are doubled and blanks kept, so that what is written reads back the same
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def stamped(name: str, run_date: dt.date) -> str:
    """``<name>_<YYYYMMDD>``; the run date is an argument, not the clock."""
    return f"{name}_{run_date:%Y%m%d}"


def write_small_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header for a report whose row count is bounded
    by its construction (years, methods, metrics, columns of the header)."""
    df.coalesce(1).write.mode("overwrite").options(**CSV).csv(path)
    return path


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: Sequence[str] = (), drop_columns: Sequence[str] = ()) -> str:
    """Full dataset, written by every task in parallel (never coalesced)."""
    out = df.drop(*drop_columns) if drop_columns else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def materialize(catalog: Catalog, path: str, spark: SparkSession | None = None) -> Catalog:
    """Write the curated titles once to Parquet and continue from the files.

    This cuts the lineage (a lost executor re-reads files instead of
    re-parsing the source) and turns an unsplittable multi-line CSV into a
    splittable, column-prunable table.
    """
    catalog.titles.write.mode("overwrite").parquet(path)
    spark = spark or catalog.titles.sparkSession
    return catalog.with_titles(spark.read.parquet(path))
