import datetime as dt
import glob

from backlist.report import run_report
from tests.fixtures import write_template


def test_report_end_to_end(spark, tmp_path):
    src = write_template(str(tmp_path / "in" / "catalog.csv"))
    out = str(tmp_path / "out")
    w = run_report(spark, src, out, run_date=dt.date(2026, 1, 31), horizon=2)
    assert w["time_series_data"].endswith("time_series_data_20260131")
    ts = spark.read.option("header", "true").csv(w["time_series_data"]).orderBy("year").collect()
    assert [r.total_sales for r in ts] == ["4800.0", "5550.0", "6200.0"]
    summary = spark.read.option("header", "true").csv(w["projection_summary"]).collect()
    assert summary == []          # targets last+3 / last+5 are beyond a 2-year horizon
    proj = spark.read.option("header", "true").csv(w["sales_projections"])
    assert proj.count() == 3 * 4 * 2
    assert len(glob.glob(w["full_dataset"] + "/*.parquet")) >= 1
