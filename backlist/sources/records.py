"""Records of CSV files that many tasks read, quoted line breaks included.

A split can't tell from its own text whether it begins inside a quoted cell.
Two passes find out: the first counts the quotes of every split, and a prefix
over the splits of a file (one row each) gives the parity at its start; the
second gives every line the parity before it, so a split cuts its own lines
into records.  Only what a record leaves over at the edges of a split, at most
two rows per split, is put together across splits.

The records are written to the shared folder: later steps count and parse them
from there, and no step reads a file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backlist.session import shared_dir

# a record over more splits than this is taken for a misplaced quote: the job
# stops and names the file instead of gathering it in one task
MAX_SPLITS = 16


def quote_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, start, pos, line)``: start is the offset of the line's split,
    pos orders the lines of a split."""
    lines = spark.read.option("lineSep", "\n").text(list(path) if not isinstance(path, str) else path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def split_parities(lines: DataFrame) -> DataFrame:
    """``(file, start, inside, crlf)``: whether a split begins inside quotes, and
    whether the file's first line ends with CR LF."""
    per_split = lines.groupBy("file", "start").agg(
        F.sum(quote_count(F.col("line"))).alias("quotes"), F.min_by(F.endswith("line", F.lit("\r")), "pos").alias("cr"))
    order = Window.partitionBy("file").orderBy("start")  # one row for each split
    return per_split.select(
        "file", "start", (F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1).alias("inside"),
        F.first("cr").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("crlf"))


def _joined(parts: str) -> Column:
    return F.expr(f"array_join(transform(array_sort({parts}), p -> p.line), '\\n')")


def cut_lines(lines: DataFrame) -> DataFrame:
    """``(file, start, rec, text, quotes, crlf)``: the records, or their pieces,
    that a split holds; rec counts the records that begin in it, 0 being the
    rest of an earlier one."""
    w = Window.partitionBy("file", "start").orderBy("pos")
    before = F.coalesce(F.sum("quotes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("quotes", quote_count(F.col("line"))).join(split_parities(lines), ["file", "start"])
    rows = rows.withColumn("outside", (before + F.col("inside").cast("int")) % 2 == 0)
    # an empty line outside quotes is no record
    rows = rows.where(~(F.col("outside") & F.col("line").isin("", "\r")))
    rows = rows.withColumn("rec", F.sum(F.col("outside").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file", "start", "rec").agg(
        F.collect_list(F.struct("pos", "line")).alias("parts"), F.sum("quotes").alias("quotes"),
        F.first("crlf").alias("crlf")).select("file", "start", "rec", _joined("parts").alias("text"), "quotes", "crlf")


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, start, rec, text, quotes)`` of every record, written once; start
    and rec order a file's records.  A record with an odd number of quotes is
    one that the file's end leaves open."""
    folder = shared_dir(spark, "records")
    cut_lines(read_lines(spark, path)).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    edge = (F.col("rec") == 0) | (F.col("quotes") % 2 == 1)
    # the few pieces at the edges: a record is its beginning and all that follows up to the next one
    order = Window.partitionBy("file").orderBy("start", "rec")
    begun = F.sum((F.col("rec") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    long = pieces.where(edge).withColumn("_nth", begun).groupBy("file", "_nth").agg(
        F.min(F.struct("start", "rec")).alias("at"),
        F.collect_list(F.struct("start", "rec", F.col("text").alias("line"))).alias("parts"),
        F.sum("quotes").alias("quotes"), F.first("crlf").alias("crlf"), F.count(F.lit(1)).alias("n"))
    long = long.where(F.when(F.col("n") > MAX_SPLITS + 1, F.raise_error(F.format_string(
        f"%s has a record over more than {MAX_SPLITS} splits: a quote is misplaced", "file")).cast("boolean"))
        .otherwise(F.lit(True)))
    whole = pieces.where(~edge).unionByName(long.select("file", "at.start", "at.rec", _joined("parts").alias("text"), "quotes", "crlf"))
    # line ends are LF, as in a file read by one task, and a byte-order mark goes
    text = F.regexp_replace(F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")), r"\r$", "")
    text = F.when((F.col("start") == 0) & (F.col("rec") == 1), F.ltrim(text, F.lit("\ufeff"))).otherwise(text)
    return whole.select("file", "start", "rec", text.alias("text"), "quotes")
