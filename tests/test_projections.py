"""Projection properties on hand-made series (many series at once)."""

import numpy as np
import pytest

from backlist.operators import projections as prj

METRICS = ("total_sales", "total_quantity", "active_titles", "revenue_per_title")


def series_df(spark, series: dict[str, dict[int, float]]):
    rows = []
    for key, pts in series.items():
        for year, v in pts.items():
            rows.append((key, year, float(v), float(v), int(max(v, 0)), float(v)))
    return spark.createDataFrame(rows, "k string, year int, total_sales double, total_quantity double, "
                                       "active_titles bigint, revenue_per_title double")


def run(spark, series, **kw):
    years = sorted({y for pts in series.values() for y in pts})
    df = series_df(spark, series)
    out = prj.project(df, ["k"], years=years, last_year=kw.pop("last_year", 2024), **kw)
    return {(r.k, r.method, r.metric, r.year): r.value for r in out.collect()}


def test_exact_line_and_parabola(spark):
    line = {y: 100 + 7 * (y - 2016) for y in range(2016, 2025)}
    para = {y: 1000 + 3 * (y - 2016) ** 2 for y in range(2016, 2025)}
    p = run(spark, {"line": line, "para": para})
    for i, y in enumerate(range(2025, 2030)):
        assert p[("line", "Linear", "total_sales", y)] == pytest.approx(100 + 7 * (y - 2016), rel=1e-9)
        assert p[("line", "Polynomial", "total_sales", y)] == pytest.approx(100 + 7 * (y - 2016), rel=1e-9)
        assert p[("para", "Polynomial", "total_sales", y)] == pytest.approx(1000 + 3 * (y - 2016) ** 2, rel=1e-9)


def test_against_numpy_and_recurrence(spark):
    rng = np.random.default_rng(7)
    series = {f"s{i}": {y: float(rng.uniform(50, 500)) for y in range(2016, 2025)} for i in range(5)}
    p = run(spark, series, horizon=3)
    for k, pts in series.items():
        x = np.array(sorted(pts), dtype=float)
        y = np.array([pts[v] for v in sorted(pts)])
        fut = np.array([2025, 2026, 2027], dtype=float)
        lin = np.polyval(np.polyfit(x - 2024, y, 1), fut - 2024)
        quad = np.polyval(np.polyfit(x - 2024, y, 2), fut - 2024)
        s = [y[0]]
        for v in y[1:]:
            s.append(0.3 * v + (1 - 0.3) * s[-1])
        trend = (s[-1] - s[-3]) / 2
        for i, yr in enumerate((2025, 2026, 2027)):
            assert p[(k, "Linear", "total_sales", yr)] == pytest.approx(max(lin[i], 0), rel=1e-9)
            assert p[(k, "Polynomial", "revenue_per_title", yr)] == pytest.approx(quad[i], rel=1e-9)
            assert p[(k, "Exponential Smoothing", "total_sales", yr)] == pytest.approx(
                max(0, s[-1] + trend * (i + 1)), rel=1e-12)


def test_guards(spark):
    p = run(spark, {"one": {2024: 5.0}, "two": {2023: 10.0, 2024: 20.0}, "zero": {2022: 0.0, 2023: 0.0, 2024: 0.0},
                    "const": {2020: 7.0, 2021: 7.0, 2022: 7.0, 2023: 7.0, 2024: 7.0}})
    assert not [k for k in p if k[0] == "one"]                       # < 2 points: nothing
    assert p[("two", "Polynomial", "total_sales", 2025)] == p[("two", "Linear", "total_sales", 2025)] == 30.0
    assert p[("two", "Exponential Smoothing", "total_sales", 2025)] == pytest.approx(13.0 + 3.0)
    assert all(v == 0.0 for k, v in p.items() if k[0] == "zero")
    assert all(v == pytest.approx(7.0) for k, v in p.items() if k[0] == "const")


def test_confidence_brackets_and_floor(spark):
    falling = {y: 1000 - 300 * (y - 2020) for y in range(2020, 2025)}   # crosses zero soon
    lo = run(spark, {"f": falling}, confidence="Conservative")
    mid = run(spark, {"f": falling})
    hi = run(spark, {"f": falling}, confidence="Optimistic")
    y_n = falling[2024]
    for k, v in mid.items():
        if k[1] == "Linear" and k[2] == "revenue_per_title":
            # not floored: may go negative; the multiplier scales the change from y_n
            assert (lo[k] - y_n) == pytest.approx(0.8 * (v - y_n))
            assert (hi[k] - y_n) == pytest.approx(1.2 * (v - y_n))
            assert v < 0
        if k[2] == "total_sales":
            assert v >= 0.0


def test_missing_middle_year_uses_positions(spark):
    s = {"g": {2020: 10.0, 2021: 20.0, 2023: 40.0}}
    p = run(spark, s, horizon=1)
    # smoothing counts points, regressions use calendar years
    s1, s2 = 10.0, 0.3 * 20 + 0.7 * 10
    s3 = 0.3 * 40 + 0.7 * s2
    assert p[("g", "Exponential Smoothing", "total_sales", 2025)] == pytest.approx(s3 + (s3 - s1) / 2)
    x = np.array([2020, 2021, 2023.0]); y = np.array([10, 20, 40.0])
    assert p[("g", "Linear", "total_sales", 2025)] == pytest.approx(np.polyval(np.polyfit(x, y, 1), 2025))


def test_horizon_validation(spark):
    df = series_df(spark, {"a": {2023: 1.0, 2024: 2.0}})
    with pytest.raises(ValueError):
        prj.project(df, ["k"], years=[2023, 2024], last_year=2024, horizon=6)


def test_series_longer_than_bound_fails(spark):
    df = series_df(spark, {"a": {2022: 1.0, 2023: 2.0, 2024: 3.0}})
    with pytest.raises(Exception):
        prj.project(df, ["k"], years=[2023, 2024], last_year=2024).collect()
