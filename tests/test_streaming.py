import os

from pyspark.sql import functions as F

from backlist.streaming import ingest_uploads
from tests.fixtures import write_rows, write_template


def test_uploads_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    write_template(str(landing / "a.csv"))
    write_template(str(landing / "b.csv"))
    write_rows(str(landing / "bad.csv"), ["Title", "Net Sales $ 2024"], [["x", "1"]])
    out, rep = str(tmp_path / "curated"), str(tmp_path / "reports")
    q = ingest_uploads(spark, str(landing), out, report_out=rep, checkpoint=str(tmp_path / "ck"),
                       files_per_trigger=2, available_now=True)
    q.awaitTermination(120)
    titles = spark.read.parquet(out)
    assert titles.count() == 6
    assert titles.select("upload").distinct().count() == 2
    assert sorted(r.title_key for r in titles.where(F.col("upload").endswith("a.csv")).collect()) == \
        ["w1_0", "w2_1", "w3_2"]
    reports = spark.read.parquet(rep)
    assert reports.where(F.col("upload").endswith("bad.csv") & (F.col("severity") == "error")).count() >= 1
    # nothing new: a second catch-up run processes no files
    q2 = ingest_uploads(spark, str(landing), out, checkpoint=str(tmp_path / "ck"), available_now=True)
    q2.awaitTermination(120)
    assert spark.read.parquet(out).count() == 6
