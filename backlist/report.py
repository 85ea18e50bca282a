"""End-to-end run over one catalog export: validate and curate it in one pass,
write every report (the exports a user of the catalog views takes away), and
publish them together; ``sources.exports.read_export`` reads the newest ones.

    python -m backlist <catalog.csv> <out_dir> [--years 2016-2024] [--last-year 2024]
        [--horizon 3] [--confidence Moderate] [--run-date 2026-01-31] [--whole-files]
        [--drop-malformed] [--column-dates] [--dataset-format csv] [--hide work_ref,imprint]
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from backlist.operators import category as cat
from backlist.operators import projections as prj
from backlist.operators import series as ser
from backlist.operators import titles as tit
from backlist.sources import csv_catalog as csvc
from backlist.sources import sinks
from backlist.sources.exports import Export
from backlist.sources.roles import DEFAULT_YEARS, describe_roles


def run_report(spark: SparkSession, path: str, out: str, *, run_date: dt.date,
               years: Sequence[int] = DEFAULT_YEARS, horizon: int = 3,
               confidence: str = "Moderate", last_year: int | None = None, splittable: bool = True,
               malformed: str = "fail", column_layouts: bool = False, dataset_format: str = "parquet",
               hidden: Sequence[str] = ()) -> dict[str, str]:
    """``last_year`` anchors the projections (default: the last of ``years``,
    whatever years the catalog has).  ``splittable`` reads each file with many
    tasks; ``malformed`` fails on malformed records or drops (and counts) them;
    ``hidden`` columns are left out of the full dataset.  The export is parsed
    once: validation is observed while the titles are written.  All outputs are
    published together at the end; an export that fails validation leaves its
    report in ``<out>/rejected_<date>`` and what was published before as it was."""
    years = tuple(years)
    anchor = max(years) if last_year is None else last_year
    raw = csvc.read_catalog(spark, path, years=years, splittable=splittable)
    run = Export(spark, out, run_date)
    ok, report, catalog = csvc.curate_to(raw, run.path("curated_titles", stamped=False), malformed=malformed,
                                         column_layouts=column_layouts)
    if not ok:
        rejected = sinks.write_small_csv(report, f"{out}/{sinks.stamped('rejected', run_date)}")
        raise csvc.CatalogError(f"{path} failed validation; see {rejected}")
    run.small("validation", report, stamped=False)
    run.note("curated_titles", run.path("curated_titles", stamped=False), "parquet", catalog.titles)
    latest = catalog.latest()
    yearly = ser.yearly_summary(catalog)
    growth = ser.yoy_growth(yearly)
    # a few rows each: years, methods, bins, columns, or the top of a ranking
    small = {
        "column_inventory": describe_roles(spark, raw.roles).select(
            "sales_columns", "quantity_columns", "total_columns", F.concat_ws(" ", "series_years").alias("series_years"),
            "latest_sales_column", F.concat_ws("; ", "warnings").alias("warnings")),
        "time_series_data": yearly.orderBy("year"),
        "analysis_summary": ser.analysis_summary(ser.portfolio_kpis(catalog, yearly)),
        "growth": growth.orderBy("year"),
        "top_titles": tit.top_titles(latest),
        "sales_histogram": tit.sales_histogram(latest).orderBy("bin"),
        "quartiles": tit.quartile_comparison(latest),
    }
    if catalog.latest_year is not None and catalog.years:
        proj = prj.project(yearly, years=catalog.years, last_year=anchor, horizon=horizon, confidence=confidence)
        small["sales_projections"] = proj
        small["projection_summary"] = prj.projection_summary(proj, anchor, horizon)
    for name, need, fn in (("top_disciplines", "discipline", cat.top_disciplines),
                           ("editor_top10", "acquisition_editor", cat.editor_top10)):
        if need in latest.columns:
            small[name] = fn(latest)
    for name, df in small.items():
        run.small(name, df)
    # a row per category: bounded by the data, so datasets
    tables = {"publication_years": ("fiscal_year", lambda: tit.pubyear_performance(latest, catalog.latest_year))}
    if catalog.dims:
        tables["category_analysis"] = (catalog.dims[0], lambda: cat.category_analysis(latest, catalog.dims))
    for name, need, fn in (("editors", "acquisition_editor", cat.editor_metrics),
                           ("edition_counts", "edition_status", cat.edition_status_counts),
                           ("edition_sales", "edition_status", cat.edition_status_sales),
                           ("formats", "reporting_product_type", cat.format_performance),
                           ("positions", "catalog_position", cat.catalog_position),
                           ("legacy", "legacy_library", cat.legacy_performance),
                           ("investment", "high_investment_group", cat.investment_groups),
                           ("copublishing", "copub", cat.copub_comparison)):
        tables[name] = (need, lambda fn=fn: fn(latest))
    for name, (need, table) in tables.items():
        if need in latest.columns:
            run.dataset(name, table(), fmt="csv")
    run.dataset("full_dataset", catalog.titles, fmt=dataset_format, drop_columns=hidden)
    run.commit()
    return run.paths


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="backlist")
    ap.add_argument("catalog")
    ap.add_argument("out")
    ap.add_argument("--years", default="2016-2024")
    ap.add_argument("--last-year", type=int, default=None)
    ap.add_argument("--horizon", type=int, default=3)
    ap.add_argument("--confidence", default="Moderate")
    ap.add_argument("--run-date", default=None)
    ap.add_argument("--whole-files", action="store_true", help="read each file in one task")
    ap.add_argument("--drop-malformed", action="store_true", help="leave malformed records out instead of failing")
    ap.add_argument("--column-dates", action="store_true", help="elect one date layout for each column")
    ap.add_argument("--dataset-format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--hide", default="", help="columns to leave out of the full dataset, separated by commas")
    a = ap.parse_args(argv)
    lo, hi = (int(x) for x in a.years.split("-"))
    run_date = dt.date.fromisoformat(a.run_date) if a.run_date else dt.date.today()
    spark = SparkSession.builder.appName("backlist-report").getOrCreate()
    for name, p in run_report(spark, a.catalog, a.out, run_date=run_date, years=range(lo, hi + 1),
                              horizon=a.horizon, confidence=a.confidence, last_year=a.last_year,
                              splittable=not a.whole_files, malformed="drop" if a.drop_malformed else "fail",
                              column_layouts=a.column_dates, dataset_format=a.dataset_format,
                              hidden=[c for c in a.hide.split(",") if c]).items():
        print(f"{name}\t{p}")


if __name__ == "__main__":
    main()
