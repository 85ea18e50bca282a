"""Sums, quantiles and ingest that must not depend on layout or lose data."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from backlist.functions.agg import money_sum
from backlist.functions.clean import parse_date
from backlist.plans.ordinal import with_file_ordinal
from backlist.plans.quantiles import exact_quantiles
from backlist.session import checkpoint_root
from backlist.sources import csv_catalog as csvc
from tests.fixtures import write_rows


def total(df):
    return df.agg(money_sum("v").alias("t")).first().t


def test_sums_keep_every_digit(spark):
    assert total(spark.range(1000).select(F.lit(0.00004).alias("v"))) == 0.04
    assert total(spark.range(1_000_000).select(F.lit(1.23456789).alias("v"))) == 1234567.89


def test_sums_do_not_depend_on_partitions_or_large_values(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 1e6, 3000).round(2), rng.normal(0, 1, 3000), [3e15, -3e15, 0.1, 1e-7]])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {total(df.repartition(n)) for n in (1, 8, 200)}
    assert len(got) == 1
    assert got.pop() == pytest.approx(float(sum(map(__import__("fractions").Fraction, vals.tolist()))), rel=1e-12)
    assert total(df.union(spark.createDataFrame([(float("inf"),)], "v double"))) == float("inf")
    assert total(df.where("v is null")) is None


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_quantiles_without_exchange_reuse(spark, reuse):
    before = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(300_000).select((F.xxhash64("id") % 100_003).cast("double").alias("s"), "id")
        got = exact_quantiles(df, "s", [0.25, 0.5, 0.75], tiebreak="id").first()
        want = df.select(F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert list(got) == pytest.approx(want, rel=1e-12)


def test_files_are_ordered_by_number(spark, tmp_path):
    d = tmp_path / "many"
    for k in (99998, 99999, 100000):
        write_rows(str(d / f"part-{k}.csv"), ["v"], [[k]])
    scan = spark.read.schema("v string").option("multiLine", "true").csv(str(d))
    got = with_file_ordinal(scan, header=True).orderBy("row_id").collect()
    assert [(r.v, r.row_id) for r in got] == [("99998", 0), ("99999", 1), ("100000", 2)]


HEADER = ["WorkRef", "PubDate", "FiscalYearOfPublication", "Calendar Year 2023 Net Sales", "Calendar Year 2024 Net Sales"]


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    d = tmp_path / "two"
    write_rows(str(d / "a.csv"), HEADER, [["w1", "2020-01-01", "2020", "1", "2"]])
    write_rows(str(d / "b.csv"), HEADER[:3] + HEADER[:2:-1], [["w2", "2020-01-01", "2020", "3", "4"]])
    raw = csvc.read_catalog(spark, str(d), years=(2023, 2024))
    with pytest.raises(Exception, match="b.csv"):
        raw.df.collect()


def test_surplus_cells_are_reported(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text(",".join(HEADER) + "\nw1,2020-01-01,2020,1,2,99,98\nw2,2020-01-01,2020,1,2\n")
    _, report = csvc.validate(csvc.read_catalog(spark, str(p), years=(2023, 2024)))
    row = report.where("check = 'surplus_cells'").first()
    assert (row.severity, row.n_bad, row.n_rows) == ("error", 1, 2)
    assert csvc.data_errors(report) == ["1 of 2 rows have cells beyond the header"]


def test_splittable_read_is_checked(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    rows = [f'w{k},2020-01-01,2020,"1,{k % 10}00",2' for k in range(2000)]
    good.write_text("\n".join([",".join(HEADER), *rows]) + "\n")
    bad.write_text(",".join(HEADER) + '\n"w\n1",2020-01-01,2020,1,2\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = csvc.read_catalog(spark, str(good), years=(2023, 2024), splittable=True)
        assert spark.read.csv(str(good)).rdd.getNumPartitions() > 1
        got = raw.df.orderBy("row_id").select("row_id", "_c0").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.row_id, r._c0) for r in got] == [(k, f"w{k}") for k in range(2000)]
    raw = csvc.read_catalog(spark, str(bad), years=(2023, 2024), splittable=True)
    assert [(r.row_id, r._c0) for r in raw.df.collect()] == [(0, "w\n1")]


def test_validate_starts_no_job(spark, tmp_path):
    p = tmp_path / "one.csv"
    p.write_text(",".join(HEADER) + "\nw1,2020-01-01,2020,x,2\n")
    raw = csvc.read_catalog(spark, str(p), years=(2023, 2024))
    spark.sparkContext.setJobGroup("lazy", "validate")
    csvc.validate(raw)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("text", ["2020-1-5", "2020-01-05T00:00:00", "Jan 5, 2020", "5 January 2020", "20200105", "1/5/2020 10:00"])
def test_date_layouts(spark, text):
    assert str(spark.createDataFrame([(text,)], "t string").select(parse_date("t")).first()[0]) == "2020-01-05"


def test_checkpoint_root_is_the_configured_folder(spark):
    assert os.path.isdir(checkpoint_root(spark).removeprefix("file:"))


def test_a_cluster_without_a_shared_folder_is_refused():
    from unittest.mock import MagicMock
    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(spark)
