"""Catalog uploads as a stream.

Each CSV dropped into a landing folder is one upload: its own header, its
own years.  A ``binaryFile`` stream discovers new files (only the ``path``
column is selected, so file contents are not read by the stream itself);
``foreachBatch`` then validates and curates each new upload with the batch
operators and appends the curated titles to a Parquet table, tagged with the
upload path.  Writing each micro-batch to its own ``batch=<id>`` folder in
overwrite mode makes a replayed batch (after a failure) idempotent, and the
stream checkpoint records which files were done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from backlist.session import checkpoint_root
from backlist.sources import csv_catalog as csvc
from backlist.sources.roles import DEFAULT_YEARS


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _process(spark: SparkSession, batch: DataFrame, batch_id: int, out: str,
             years: Sequence[int], report_out: str | None) -> None:
    # at most maxFilesPerTrigger paths: metadata, not data
    paths = sorted(r.path for r in batch.select("path").distinct().collect())
    curated, reports = [], []
    for p in paths:
        raw = csvc.read_catalog(spark, p, years=years)
        ok, report = csvc.validate(raw)
        rows = report.collect()            # a few rows per column of the header
        report = spark.createDataFrame(rows, csvc.REPORT_SCHEMA)
        reports.append(report.select(F.lit(p).alias("upload"), "*"))
        if not ok or any(r["check"] in csvc.DATA_ERRORS for r in rows):
            continue                      # rejected upload: only its report is kept
        cat = csvc.curate(raw)
        curated.append(cat.titles.select(F.lit(p).alias("upload"), "*"))
    target = f"{out}/batch={batch_id}"
    if curated:
        df = curated[0]
        for c in curated[1:]:
            df = df.unionByName(c, allowMissingColumns=True)
        df.write.mode("overwrite").parquet(target)
    if report_out and reports:
        r = reports[0]
        for x in reports[1:]:
            r = r.unionByName(x)
        r.write.mode("overwrite").parquet(f"{report_out}/batch={batch_id}")


def ingest_uploads(spark: SparkSession, landing: str, out: str, *, years: Sequence[int] = DEFAULT_YEARS,
                   report_out: str | None = None, checkpoint: str | None = None,
                   files_per_trigger: int = 16, available_now: bool = False) -> StreamingQuery:
    """Start the upload stream; returns the running query.

    ``available_now=True`` processes what is in the landing folder and stops
    (batch-style catch-up); otherwise it keeps watching.
    """
    ckpt = checkpoint or f"{checkpoint_root(spark)}/uploads-stream"
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", files_per_trigger).load(landing).select("path"))
    w = (files.writeStream.option("checkpointLocation", ckpt)
         .foreachBatch(lambda b, i: _process(spark, b, i, out, years, report_out)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
