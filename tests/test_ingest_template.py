"""F1 golden values, end to end from a real CSV with multi-line headers."""

import os

import pytest
from pyspark.sql import functions as F

from backlist.operators import category as cat
from backlist.operators import projections as prj
from backlist.operators import series as ser
from backlist.operators import titles as tit
from backlist.sources import csv_catalog as csvc
from tests.fixtures import write_template

YEARS = range(2016, 2025)


@pytest.fixture(scope="module")
def template(spark, tmp_path_factory):
    path = write_template(str(tmp_path_factory.mktemp("tpl") / "template.csv"))
    raw = csvc.read_catalog(spark, path)
    return raw, csvc.curate(raw)


def approx(a, b, tol=1e-6):
    return a is not None and abs(a - b) <= tol * max(1.0, abs(b))


def test_headers_and_roles(template):
    raw, cur = template
    assert raw.roles.names[7] == '" Net Sales $ \n2022 "'
    assert cur.years == (2022, 2023, 2024) and cur.latest_year == 2024
    ok, report = csvc.validate(raw)
    assert ok
    rows = report.collect()
    assert all(r.severity == "ok" for r in rows if r.check == "numeric_content")


def test_title_key(template):
    _, cur = template
    keys = [r.title_key for r in cur.titles.orderBy("row_id").collect()]
    assert keys == ["w1_0", "w2_1", "w3_2"]


def test_yearly_summary_golden(template):
    _, cur = template
    y = {r.year: r for r in ser.yearly_summary(cur).collect()}
    assert [y[k].total_sales for k in (2022, 2023, 2024)] == [4800.0, 5550.0, 6200.0]
    assert [y[k].total_quantity for k in (2022, 2023, 2024)] == [90.0, 103.0, 117.0]
    assert [y[k].active_titles for k in (2022, 2023, 2024)] == [3, 3, 3]
    assert approx(y[2024].revenue_per_title, 2066.6667)


def test_growth_golden(template):
    _, cur = template
    yearly = ser.yearly_summary(cur)
    g = [r.sales_growth for r in ser.yoy_growth(yearly).orderBy("year").collect()]
    assert g[0] is None and approx(g[1], 15.625) and approx(g[2], 11.7117117)
    gi = ser.growth_insights(yearly).first()
    assert approx(gi.total_growth_pct, 29.1666667) and approx(gi.avg_growth_pct, 13.6683559)
    k = ser.portfolio_kpis(cur, yearly).first()
    assert k.total_titles == 3 and k.latest_year == 2024 and approx(k.sales_growth_pct, 11.7117117)
    s = {r.metric: r.value for r in ser.analysis_summary(ser.portfolio_kpis(cur, yearly)).collect()}
    assert s == {"Total Titles": 3.0, "Latest Year Sales": 6200.0, "Active Titles": 3.0,
                 "Revenue per Title": pytest.approx(2066.6667, rel=1e-6)}


def _proj(cur, **kw):
    yearly = ser.yearly_summary(cur)
    p = prj.project(yearly, years=cur.years, last_year=2024, horizon=2, **kw)
    return {(r.method, r.metric, r.year): r.value for r in p.collect()}


def test_projection_golden(template):
    _, cur = template
    p = _proj(cur)
    assert approx(p[("Linear", "total_sales", 2025)], 6916.6667)
    assert approx(p[("Linear", "total_sales", 2026)], 7616.6667)
    assert approx(p[("Polynomial", "total_sales", 2025)], 6750.0)
    assert approx(p[("Polynomial", "total_sales", 2026)], 7200.0)
    assert approx(p[("Exponential Smoothing", "total_sales", 2025)], 5666.25)
    assert approx(p[("Exponential Smoothing", "total_sales", 2026)], 5955.0)
    c = _proj(cur, confidence="Conservative")
    o = _proj(cur, confidence="Optimistic")
    assert approx(c[("Linear", "total_sales", 2025)], 6773.3333)
    assert approx(o[("Linear", "total_sales", 2025)], 7060.0)
    assert approx(c[("Exponential Smoothing", "total_sales", 2025)], 5608.5)


def test_category_and_quartiles_golden(template):
    _, cur = template
    latest = cur.latest()
    ca = cat.category_analysis(latest, cur.dims).where(F.col("dimension") == "JJ: Reporting Type 2")
    got = {r.category: (r.total_sales, r.title_count, r.revenue_per_title) for r in ca.collect()}
    assert got == {"b. eBook": (3000.0, 1, 3000.0), "a. Print": (3200.0, 2, 1600.0)}
    q = {r.quartile: r for r in tit.quartile_comparison(latest).collect()}
    assert q["Top 25%"].threshold == 2500.0 and q["Bottom 25%"].threshold == 1600.0
    assert (q["Top 25%"].title_count, q["Top 25%"].avg_sales) == (1, 3000.0)
    assert (q["Bottom 25%"].title_count, q["Bottom 25%"].avg_sales) == (1, 1200.0)


def test_top_titles_preview_histogram(template):
    _, cur = template
    latest = cur.latest()
    top = tit.top_titles(latest).collect()
    assert [r.title_key for r in top] == ["w2_1", "w1_0", "w3_2"]
    assert top[0].sales_text == "$3,000"
    assert [r.title_key for r in tit.preview(cur.titles).collect()] == ["w1_0", "w2_1", "w3_2"]
    h = tit.sales_histogram(latest).collect()
    assert len(h) == 30 and sum(r.title_count for r in h) == 3
    assert h[0].bin_start == 1200.0 and h[29].bin_end == 3000.0 and h[29].title_count == 1


def test_quartiles_approx_option(template):
    _, cur = template
    q = {r.quartile: r for r in tit.quartile_comparison(cur.latest(), approx=True).collect()}
    assert q["Top 25%"].title_count >= 1 and q["Bottom 25%"].title_count >= 1


def test_growth_rows_without_first_period(template):
    _, cur = template
    rows = ser.yoy_growth(ser.yearly_summary(cur), drop_first=True).orderBy("year").collect()
    assert [r.year for r in rows] == [2023, 2024] and approx(rows[0].sales_growth, 15.625)
