"""Global row ordinals (file order) without a global sort or a single task.

Every read block of a file gets ``offset(block)``, and its rows follow in the
order of their ids; the offsets come from one small aggregate (one row per
block of a file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_order(path: Column) -> Column:
    """Sort key that compares runs of digits as numbers: part-99999 before
    part-100000."""
    runs = F.split(path, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    return F.transform(runs, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(F.ltrim(t, F.lit("0")), 24, "0")).otherwise(t))


def with_file_ordinal(scan: DataFrame, name: str = "row_id", header: bool = False) -> DataFrame:
    """Add a 0-based ordinal in (file, row within file) order; files are
    ordered by name with numbers compared as numbers.

    ``scan`` must be a file-source DataFrame straight from ``spark.read`` (it
    uses the hidden ``_metadata`` column); files may be split.  With
    ``header`` the first record of every file is its header: it is left out,
    and a file whose header differs from the first file's fails the job by
    name instead of being read by position.
    """
    tagged = scan.select(*[F.col(c) for c in scan.columns], F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_start"),
                         F.monotonically_increasing_id().alias("_pos"))
    return with_ordinal(tagged, name, header)


def with_ordinal(tagged: DataFrame, name: str = "row_id", header: bool = False) -> DataFrame:
    """The same for rows that carry ``_file``, ``_start`` (their block) and
    ``_pos`` (without gaps, ascending, within a block)."""
    block = ["_file", "_start"]
    cols = [c for c in tagged.columns if c not in (*block, "_pos")]
    aggs = [F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")]
    if header:
        aggs.append(F.min_by(F.array(*[F.col(c).cast("string") for c in cols]), "_pos").alias("_header"))
    per_block = tagged.groupBy(*block).agg(*aggs)
    order = Window.orderBy(natural_order(F.col("_file")), "_file", "_start")  # one row per block of a file
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    skip = F.lit(0)
    if header:
        same = F.col("_header") == F.first("_header").over(order.rowsBetween(Window.unboundedPreceding, 0))
        skip = F.when(F.col("_start") == 0, F.when(same, 1).otherwise(F.raise_error(F.concat(
            F.lit("the header differs from the first file's: "), F.col("_file"))).cast("int"))).otherwise(0)
        per_block = per_block.withColumn("_skip", skip).select(
            *block, F.col("_first") + F.col("_skip"), (F.col("_n") - F.col("_skip")).alias("_n")).toDF(*block, "_first", "_n")
    offsets = per_block.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (tagged.join(offsets, block).where(F.col("_pos") >= F.col("_first"))
            .select(*[F.col(c) for c in cols],
                    (F.col("_offset") + F.col("_pos") - F.col("_first")).cast("bigint").alias(name)))
