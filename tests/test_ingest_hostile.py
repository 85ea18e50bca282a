"""one trap per row / header."""

import pytest
from pyspark.sql import functions as F

from backlist.operators import category as cat
from backlist.operators import series as ser
from backlist.operators import titles as tit
from backlist.sources import csv_catalog as csvc
from tests.fixtures import write_rows


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    header = [" WorkRef ", "Index", "BookType", "booktype", "BookType", "Edition Status", "CoPub",
              "FiscalYearOfPublication", "PubDate", "Net Sales $ 2023", "Net Sales $ 2024",
              "Net Sales $ 2024 Adj", "Net Sales Q 2024", "HighInvestmentGroup"]
    rows = [
        ["w1", "A", "Mono", "m", "x", "New", "Yes", "2020", "2020-01-15", "$1,234.50", "(500)", "10", "1,200", None],
        ["w2", "B", "NA", "m", "x", "NA", "Yes", "bad", "bad", "abc", "$ (1,000) ", "20", "7", None],
        [None, "C", " NA", "m", "x", "-", "Yes", "2021.0", "", "nan", "1e3", "30", "nan", None],
        ["w4", "D", "Mono", "m", "x", None, "Yes", "1e12", "2019/11/08", None, "1.5d", "40", "", None],
    ]
    path = write_rows(str(tmp_path_factory.mktemp("hostile") / "h.csv"), header, rows)
    raw = csvc.read_catalog(spark, path)
    return raw, csvc.curate(raw)


def test_header_handling(hostile):
    raw, _ = hostile
    assert raw.roles.names[:5] == ("WorkRef", "Index", "BookType", "booktype", "BookType.1")
    assert raw.roles.sales_by_year[2024] == "Net Sales $ 2024"
    assert raw.roles.latest_sales() == (2024, "Net Sales $ 2024 Adj")


def test_values(hostile):
    _, cur = hostile
    rows = cur.titles.orderBy("row_id").collect()
    assert [r.title_key for r in rows] == ["A", "B", "C", "D"]
    assert [r.sales_2023 for r in rows] == [1234.5, 0.0, 0.0, 0.0]
    assert [r.sales_2024 for r in rows] == [-500.0, -1000.0, 1000.0, 0.0]
    assert [r.latest_sales for r in rows] == [10.0, 20.0, 30.0, 40.0]
    assert [r.qty_2024 for r in rows] == [0.0, 7.0, 0.0, 0.0]
    assert [r.qty_2023 for r in rows] == [0.0, 0.0, 0.0, 0.0]     # no quantity column for 2023
    assert [r.book_type for r in rows] == ["Mono", None, " NA", "Mono"]
    assert [r.fiscal_year for r in rows] == [2020, None, 2021, None]
    assert rows[1].pub_date is None and rows[2].pub_date is None and str(rows[3].pub_date) == "2019-11-08"


def test_null_keys_dropped_and_copub_one_sided(hostile):
    _, cur = hostile
    latest = cur.latest()
    counts = {r.edition_status: r.title_count for r in cat.edition_status_counts(latest).collect()}
    assert counts == {"New": 1, "-": 1}
    c = cat.copub_comparison(latest).first()
    assert (c.copub_titles, c.non_copub_titles) == (4, 0)
    assert c.copub_avg_sales is None and c.non_copub_avg_sales is None
    # a wholly NULL dimension yields no groups
    assert cat.investment_groups(latest).count() == 0
    yearly = ser.yearly_summary(cur).orderBy("year").collect()
    assert [r.year for r in yearly] == [2023, 2024]
    assert yearly[1].active_titles == 1 and yearly[1].total_sales == -500.0


def test_validation_report(spark, hostile):
    raw, _ = hostile
    ok, rep = csvc.validate(raw)
    assert ok
    bad = {r.column: r.n_bad for r in rep.where(F.col("check") == "numeric_content").collect()}
    assert bad["Net Sales $ 2023"] == 1 and bad["Net Sales $ 2024"] == 1


def test_missing_columns_and_empty(spark, tmp_path):
    p = write_rows(str(tmp_path / "e.csv"), ["WorkRef", "Net Sales $ 2024"], [])
    ok, rep = csvc.validate(csvc.read_catalog(spark, p))
    checks = {r.check for r in rep.collect()}
    assert not ok and {"empty", "required_columns", "quantity_columns"} <= checks
    with pytest.raises(csvc.CatalogError):
        csvc.curate(csvc.read_catalog(spark, p))
    with pytest.raises(csvc.CatalogError):
        csvc.read_first(spark, [str(tmp_path / "nope.csv"), str(tmp_path / "nope2.csv")])


def test_ties_and_equal_sales(spark, tmp_path):
    header = ["WorkRef", "PubDate", "FiscalYearOfPublication", "Net Sales $ 2024"]
    rows = [[f"w{i}", "2020-01-01", "2020", "5"] for i in range(25)]
    cur = csvc.curate(csvc.read_catalog(spark, write_rows(str(tmp_path / "t.csv"), header, rows)))
    latest = cur.latest()
    top = [r.title_key for r in tit.top_titles(latest).collect()]
    assert top == [f"w{i}_{i}" for i in range(20)]
    h = tit.sales_histogram(latest).collect()
    assert h[0].title_count == 25 and sum(r.title_count for r in h) == 25
    q = {r.quartile: r.title_count for r in tit.quartile_comparison(latest).collect()}
    assert q == {"Top 25%": 25, "Bottom 25%": 25}


def test_zero_base_year_growth(spark, tmp_path):
    header = ["WorkRef", "PubDate", "FiscalYearOfPublication", "Net Sales $ 2022", "Net Sales $ 2023",
              "Net Sales $ 2024"]
    rows = [["w1", "2020-01-01", "2020", "0", "100", "150"], ["w2", "2020-01-01", "2020", "0", "0", "50"]]
    cur = csvc.curate(csvc.read_catalog(spark, write_rows(str(tmp_path / "z.csv"), header, rows)))
    yearly = ser.yearly_summary(cur)
    g = {r.year: r for r in ser.yoy_growth(yearly).collect()}
    assert g[2023].sales_growth is None and g[2023].titles_growth is None     # zero base -> NULL
    assert g[2024].sales_growth == 100.0 and g[2024].titles_growth == 100.0
    gi = ser.growth_insights(yearly).first()
    assert gi.total_growth_pct is None and gi.avg_growth_pct == 100.0
    y = {r.year: r for r in yearly.collect()}
    assert y[2022].revenue_per_title == 0.0 and y[2022].active_titles == 0


def test_extra_dates_and_numeric_dims(spark, tmp_path):
    header = ["WorkRef", "PubDate", "FiscalYearOfPublication", "Net Sales $ 2024", "CatalogPosition", "Ship Date"]
    rows = [["w1", "2020-01-01", "2020", "5", "1", "2021-05-06"], ["w2", "2020-01-01", "2020", "7", "1.0", "bad"],
            ["w3", "2020-01-01", "2020", "9", "front", ""]]
    raw = csvc.read_catalog(spark, write_rows(str(tmp_path / "n.csv"), header, rows))
    cur = csvc.curate(raw, dates=["Ship Date"], numeric_dims=["CatalogPosition"])
    r = cur.titles.orderBy("row_id").collect()
    assert [str(x.ship_date_date) for x in r] == ["2021-05-06", "None", "None"]
    groups = {x.catalog_position: x.title_count for x in cat.catalog_position(cur.latest()).collect()}
    assert groups == {"1.0": 2, "front": 1}
    plain = {x.catalog_position for x in csvc.curate(raw).titles.collect()}
    assert plain == {"1", "1.0", "front"}
