import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from backlist.operators import category as cat
from backlist.operators import series as ser
from backlist.sources import sinks
from backlist.sources.testdata import tpch_catalog
from tests.conftest import SF0001


def test_small_csv_and_dataset_sinks(spark, tmp_path):
    c = tpch_catalog(spark, SF0001)
    yearly = ser.yearly_summary(c)
    out = sinks.write_small_csv(yearly, str(tmp_path / sinks.stamped("time_series_data", dt.date(2026, 1, 2))))
    assert out.endswith("time_series_data_20260102")
    files = glob.glob(os.path.join(out, "part-*.csv"))
    assert len(files) == 1 and open(files[0]).readline().startswith("year,total_sales")
    ds = sinks.write_dataset(c.title_year(), str(tmp_path / "ty"), partition_by=["year"])
    assert sorted(os.path.basename(p) for p in glob.glob(ds + "/year=*")) == [f"year={y}" for y in c.years]
    m = sinks.materialize(c, str(tmp_path / "titles"))
    assert m.titles.count() == c.titles.count()
    assert ser.yearly_summary(m).orderBy("year").collect() == ser.yearly_summary(c).orderBy("year").collect()


def test_hot_key_is_combined_before_the_shuffle(spark, tmp_path):
    """One part owns a third of all line items; results stay whole and the
    heavy aggregate is combined map-side."""
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    hot = li.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_partkey")))
    d = tmp_path / "skew"
    hot.write.parquet(str(d / "lineitem.parquet"))
    spark.read.parquet(f"{SF0001}/part.parquet").write.parquet(str(d / "part.parquet"))
    c = tpch_catalog(spark, str(d))
    yearly = ser.yearly_summary(c)
    total = yearly.agg(F.sum("total_sales")).first()[0]
    y = F.year("l_shipdate")
    kept = hot.where(y.between(1995, 2001))
    want = kept.select(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") *
                             (F.lit(1) - F.col("l_discount")).cast("decimal(4,2)"))).first()[0]
    assert total == pytest.approx(float(want), rel=1e-12)
    share = kept.where(F.col("l_partkey") == 1).count() / kept.count()
    assert share > 0.3
    plan = c.titles._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    top = cat.top_disciplines(c.latest()).count()
    assert top == 3
