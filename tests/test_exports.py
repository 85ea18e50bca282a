"""Dated exports are published whole; the report's options."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from backlist.report import run_report
from backlist.sources.csv_catalog import CatalogError
from backlist.sources.exports import Export, manifest, read_export
from tests.fixtures import write_rows, write_template

DAY = dt.date(2026, 1, 31)


def table(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def test_a_run_appears_when_it_is_committed(spark, tmp_path):
    root = str(tmp_path / "out")
    assert manifest(spark, root) == {}
    with pytest.raises(FileNotFoundError):
        read_export(spark, root, "t")
    run = Export(spark, root, DAY)
    run.small("t", table(spark, "a", None, 'say "x",\ny', ""))
    run.dataset("big", table(spark, "b").withColumn("hidden", F.lit(1)), drop_columns=["hidden"], stamped=False)
    assert manifest(spark, root) == {} and run.paths["t"].endswith("t_20260131")
    run.commit()
    got = read_export(spark, root, "t").orderBy("id")
    assert [r.text for r in got.collect()] == ["a", None, 'say "x",\ny', ""] and dict(got.dtypes) == {"id": "int", "text": "string"}
    assert read_export(spark, root, "big").columns == ["id", "text"]


def test_a_failed_run_leaves_the_former_one(spark, tmp_path):
    root = str(tmp_path / "out")
    first = Export(spark, root, DAY)
    first.small("t", table(spark, "old"))
    first.commit()
    second = Export(spark, root, DAY)
    second.small("t", table(spark, "new"))
    with pytest.raises(Exception, match="broken"):
        second.dataset("u", table(spark, "x").where(F.raise_error(F.lit("broken")).cast("boolean")))
    assert [r.text for r in read_export(spark, root, "t").collect()] == ["old"]
    third = Export(spark, root, DAY)
    third.small("t", table(spark, "newest"))
    third.commit()
    assert [r.text for r in read_export(spark, root, "t").collect()] == ["newest"]
    assert len(glob.glob(root + "/_published/*.json")) == 2 and not glob.glob(root + "/_published/*.tmp")


def test_report_publishes_and_reads_back(spark, tmp_path):
    src = write_template(str(tmp_path / "in" / "catalog.csv"))
    out = str(tmp_path / "out")
    paths = run_report(spark, src, out, run_date=DAY, horizon=3, dataset_format="csv", hidden=["work_ref", "imprint"])
    assert set(manifest(spark, out)) == set(paths)
    inventory = read_export(spark, out, "column_inventory").first()
    assert (inventory.sales_columns, inventory.quantity_columns, inventory.series_years) == (3, 3, "2022 2023 2024")
    assert {r.discipline for r in read_export(spark, out, "top_disciplines").collect()} == {"Economics", "History", "Literature"}
    full = read_export(spark, out, "full_dataset")
    assert "work_ref" not in full.columns and "imprint" not in full.columns and full.count() == 3
    assert [r.title_key for r in full.orderBy("row_id").collect()] == ["w1_0", "w2_1", "w3_2"]
    assert read_export(spark, out, "projection_summary").count() == 1
    assert read_export(spark, out, "sales_projections").count() == 36
    assert read_export(spark, out, "validation").where("severity = 'error'").count() == 0


def test_a_rejected_export_keeps_the_published_one(spark, tmp_path):
    src, out = write_template(str(tmp_path / "in" / "catalog.csv")), str(tmp_path / "out")
    run_report(spark, src, out, run_date=DAY, horizon=1)
    header = ["WorkRef", "PubDate", "FiscalYearOfPublication", "Net Sales $ 2024"]
    bad = write_rows(str(tmp_path / "bad.csv"), header, [["w1", "2020-01-01", "2020", "5", "", "99"], ["w2", "2020-01-01", "2020", "5"]])
    with pytest.raises(CatalogError, match="rejected_20260131"):
        run_report(spark, bad, out, run_date=DAY, horizon=1)
    assert read_export(spark, out, "curated_titles").count() == 3
    rejected = spark.read.option("header", "true").csv(out + "/rejected_20260131").where("check = 'surplus_cells'").first()
    assert (rejected.n_bad, rejected.n_rows) == ("1", "2")
    run_report(spark, bad, out, run_date=DAY, horizon=1, malformed="drop")
    assert read_export(spark, out, "curated_titles").count() == 1
    assert read_export(spark, out, "validation").where("check = 'surplus_cells'").first().n_bad == 1
