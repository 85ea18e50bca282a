"""Registered queries over the test tables, one per operator, each with an
equivalent DuckDB SQL oracle (see ``backlist.oracle``).

The catalog is derived from ``part`` and ``lineitem`` (FIXTURES.md, F4):
series years 1995..2001, latest year 2001, forecasts 2002..2006.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backlist.functions.agg import fixed_point, fixed_sum
from backlist.functions.clean import null_words, null_words_sql, parse_date, parse_money, parse_number, parse_quantity
from backlist.functions.fmt import pct_text, tidy_name
from backlist.functions.layouts import elect_layouts, parse_elected
from backlist.operators import category as cat
from backlist.operators import longseries as lng
from backlist.operators import projections as prj
from backlist.operators import series as ser
from backlist.operators import titles as tit
from backlist.plans import sketches
from backlist.plans.ordinal import with_file_ordinal
from backlist.session import shared_dir
from backlist.sources import csv_catalog as csvc
from backlist.sources import sinks
from backlist.sources.catalog import Catalog, qty_col, sales_col
from backlist.sources.exports import Export, read_export
from backlist.sources.roles import DIMENSIONS, ColumnRoles, detect_roles
from backlist.sources.testdata import FIRST_YEAR, LAST_YEAR, tpch_catalog

HORIZON = 5
YEARS = tuple(range(FIRST_YEAR, LAST_YEAR + 1))
SALES_HEADER = '" Net Sales $ \n{y} "'
QTY_HEADER = '" Net Sales Q\n{y} "'


def catalog(spark: SparkSession, d: str) -> Catalog:
    return tpch_catalog(spark, d)


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Per-title latest-year rows; only the latest year's line items are read."""
    return tpch_catalog(spark, d, years=[LAST_YEAR]).latest()


def yearly(spark: SparkSession, d: str, keys=()) -> DataFrame:
    return ser.yearly_summary(catalog(spark, d), keys)


# Forecasts are reported in steps of 2 ** -10: two ways of fitting differ in the
# last bits, and decimal data over a few years never fall between two steps.
GRID = 1024.0


def _reported(projections: DataFrame, grid: float = GRID) -> DataFrame:
    return projections.withColumn("value", F.floor(F.col("value") * F.lit(grid) + F.lit(0.5)) / F.lit(grid))


def _project(spark, d, keys=(), **kw):
    return _reported(prj.project(yearly(spark, d, keys), keys, years=YEARS, last_year=LAST_YEAR,
                                 horizon=HORIZON, **kw))


def q_projection_overlay(spark, d):
    out = prj.overlay(yearly(spark, d), years=YEARS, last_year=LAST_YEAR, horizon=HORIZON)
    forecast = F.col("series") != "Historical Data"
    return out.withColumn("value", F.when(forecast, F.floor(F.col("value") * GRID + 0.5) / GRID).otherwise(F.col("value")))


# ---------------------------------------------------------------- text renders
# Deterministic "messy export" text made from the numbers, so parsing can be
# checked against the numbers themselves.

def money_render_sql(value: str, variant: str, decimals: int = 2) -> str:
    """SQL text: the number as one of eight export spellings chosen by ``variant``."""
    txt = f"format_number({value}, {decimals})"
    return (f"CASE {variant} WHEN 0 THEN concat('$', {txt}) WHEN 1 THEN concat(' ', {txt}, ' ') "
            f"WHEN 2 THEN concat('$ (', {txt}, ') ') WHEN 3 THEN CAST({value} AS STRING) "
            f"WHEN 4 THEN 'N/A' WHEN 5 THEN '-' WHEN 6 THEN 'abc' "
            f"ELSE concat('(', CAST({value} AS STRING), ')') END")


def q_parse_money(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    v = "(l_orderkey + l_linenumber) % 8"
    text = F.expr(money_render_sql("l_extendedprice", v))
    return li.select("l_orderkey", "l_linenumber", F.expr(v).alias("variant"),
                     parse_money(null_words(text)).alias("amount"))


def q_parse_quantity(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.col("l_quantity")
    qi = q.cast("int").cast("string")
    u = (F.col("l_orderkey") + F.lit(2) * F.col("l_linenumber")) % 6
    text = (F.when(u == 0, q.cast("string"))
            .when(u == 1, F.concat(F.lit(" "), qi, F.lit("\t")))
            .when(u == 2, F.format_number(q * F.lit(100), 0))
            .when(u == 3, F.lit("nan"))
            .when(u == 4, F.concat(qi, F.lit("d")))
            .otherwise(F.concat(F.lit("1e"), (q.cast("int") % 3).cast("string"))))
    return li.select("l_orderkey", "l_linenumber", parse_quantity(null_words(text)).alias("quantity"))


def q_parse_dates(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    v = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    s = F.col("l_shipdate")
    text = (F.when(v == 0, F.date_format(s, "yyyy-MM-dd"))
            .when(v == 1, F.date_format(s, "M/d/yyyy"))
            .when(v == 2, F.date_format(s, "yyyy/MM/dd"))
            .when(v == 3, F.lit("bad"))
            .otherwise(F.lit("")))
    # the parsed DATE, shown as ISO text so the comparison does not depend on
    # how each engine's client converts date values
    parsed = parse_date(null_words(text))
    return li.select("l_orderkey", "l_linenumber", F.date_format(parsed, "yyyy-MM-dd").alias("ship_date"))


def q_title_key(spark, d):
    scan = spark.read.parquet(f"{d}/part.parquet")
    part = with_file_ordinal(scan, "ordinal")
    work_ref = F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("w"), F.col("p_partkey")))
    return part.select("p_partkey", csvc.synthetic_key(work_ref, F.col("ordinal")).alias("title_key"))


def rendered_export(spark, d) -> DataFrame:
    """The catalog as a messy wide text export with the export's headers
    (built as SQL expression text: one parse instead of hundreds of calls)."""
    t = catalog(spark, d).titles

    def q(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    cols = ["row_id", "title_key AS Index", "work_ref AS WorkRef", "book_type AS BookType", "discipline AS Discipline",
            "CAST(fiscal_year AS STRING) AS FiscalYearOfPublication",
            "date_format(pub_date, 'yyyy-MM-dd') AS PubDate", "imprint AS Imprint"]
    for y in YEARS:
        cols.append(f"{money_render_sql(f'sales_{y}', f'(row_id + {y}) % 8', 4)} AS {q(SALES_HEADER.format(y=y))}")
    for y in YEARS:
        cols.append(f"CASE WHEN (row_id + {y}) % 5 = 0 THEN format_number(qty_{y}, 2) "
                    f"ELSE CAST(qty_{y} AS STRING) END AS {q(QTY_HEADER.format(y=y))}")
    return t.selectExpr(*cols)


def q_validate_numeric(spark, d):
    export = rendered_export(spark, d)
    names = tuple(c for c in export.columns if c != "row_id")
    df = export.selectExpr("row_id", *[f"{null_words_sql(f'`{c}`')} AS _c{i}" for i, c in enumerate(names)])
    roles = ColumnRoles(names, tuple(SALES_HEADER.format(y=y) for y in YEARS),
                        tuple(QTY_HEADER.format(y=y) for y in YEARS), YEARS)
    _, report = csvc.validate(csvc.RawCatalog(df, roles, "rendered"))
    return (report.where(F.col("check") == "numeric_content")
            .select(F.regexp_extract("column", "([0-9]{4})", 1).cast("int").alias("year"),
                    "severity", "n_bad", "n_rows"))


def q_ingest_catalog(spark, d):
    """Write the messy export as CSV to the shared folder, read it back as a
    user's file would be, curate it, and return its (title, year) table.  The
    export carries its titles' keys, so its rows need no order."""
    path = shared_dir(spark, "ingest")
    export = rendered_export(spark, d)
    export.drop("row_id").write.option("header", "true").option("escape", '"').csv(path)
    raw = csvc.read_catalog(spark, path, years=YEARS)
    ok, _ = csvc.validate(raw)
    if not ok:
        raise csvc.CatalogError("rendered export failed validation")
    cur = csvc.curate(raw)
    return cur.title_year(carry=["title_key"]).select("title_key", "year", "net_sales", "net_qty")


def q_parse_number(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    v = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    text = (F.when(v == 0, F.col("l_extendedprice").cast("string"))
            .when(v == 1, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ")))
            .when(v == 2, F.lit("N/A")).otherwise(F.lit("x1")))
    return li.select("l_orderkey", "l_linenumber", parse_number(null_words(text)).alias("number"))


def q_growth_text(spark, d):
    growth = ser.yoy_growth(yearly(spark, d))
    return growth.select("year", pct_text(F.col("sales_growth")).alias("growth_text"))


def q_type_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    return part.groupBy(tidy_name(raw).alias("type_name")).agg(F.count(F.lit(1)).alias("title_count"))


def _numbered(titles: DataFrame, headers: dict[str, str], **roles) -> csvc.RawCatalog:
    """A text catalog with the given headers, each over an expression of the
    curated titles; ``roles`` are options of ``detect_roles``."""
    names = list(headers)
    text = titles.selectExpr("row_id", *[f"{e} AS _c{i}" for i, e in enumerate(headers.values())])
    df = text.selectExpr("row_id", *[f"{null_words_sql(f'_c{i}')} AS _c{i}" for i in range(len(names))])
    return csvc.RawCatalog(df, detect_roles(names, YEARS, **roles), "rendered")


KEYS = {"WorkRef": "work_ref", "PubDate": "date_format(pub_date, 'yyyy-MM-dd')",
        "FiscalYearOfPublication": "CAST(fiscal_year AS STRING)"}


def _text(name: str) -> str:
    return f"CAST(`{name}` AS STRING)"


def q_loose_roles(spark, d):
    """Yearly series of an export whose columns are found by loose key words."""
    headers = KEYS | {f"Revenue {y}": _text(sales_col(y)) for y in YEARS} | {f"Copies {y}": _text(qty_col(y)) for y in YEARS}
    return ser.yearly_summary(csvc.curate(_numbered(catalog(spark, d).titles, headers, mode="loose")))


def q_explicit_roles(spark, d):
    """The same of columns that are named one by one."""
    money, number = ([f"{word} {y}" for y in YEARS] for word in ("Turnover", "Pieces"))
    headers = KEYS | {c: _text(sales_col(y)) for c, y in zip(money, YEARS)} | {c: _text(qty_col(y)) for c, y in zip(number, YEARS)}
    return ser.yearly_summary(csvc.curate(_numbered(catalog(spark, d).titles, headers, sales=money, quantity=number)))


def q_latest_by_role(spark, d):
    """Two sales columns of the last year: the series takes the first one, the
    latest-year views the last name."""
    headers = KEYS | {SALES_HEADER.format(y=y).strip('" '): _text(sales_col(y)) for y in YEARS}
    headers |= {f"Net Sales $ {LAST_YEAR} restated": f"CAST(2 * {sales_col(LAST_YEAR)} AS STRING)"}
    cur = csvc.curate(_numbered(catalog(spark, d).titles, headers))
    return cur.titles.select("title_key", F.col(sales_col(LAST_YEAR)).alias("series_sales"), "latest_sales")


def q_validation_report(spark, d):
    """An export without its publication dates and quantity columns, and with
    text that isn't money."""
    headers = {k: v for k, v in KEYS.items() if k != "PubDate"}
    headers |= {f"Net Sales $ {y}": money_render_sql(sales_col(y), f"(row_id + {y}) % 8", 4) for y in YEARS}
    _, report = csvc.validate(_numbered(catalog(spark, d).titles, headers))
    return report.select("check", "severity", "column", "n_bad", "n_rows")


def q_series_sink(spark, d):
    """The yearly series, written as one CSV file and read again."""
    df = yearly(spark, d).orderBy("year")
    return spark.read.schema(df.schema).option("header", "true").csv(
        sinks.write_small_csv(df, shared_dir(spark, "series")))


def q_dataset_sink(spark, d):
    """The curated titles, written as a dataset and read again."""
    cur = sinks.materialize(catalog(spark, d), shared_dir(spark, "titles"))
    return cur.latest().select("row_id", "title_key", "book_type", "fiscal_year", "sales")


def q_projection_sink(spark, d, name="sales_projections"):
    """Both projection exports, published under their date and read again."""
    root = shared_dir(spark, "exports")
    run = Export(spark, root, dt.date(LAST_YEAR, 12, 31))
    proj = _project(spark, d)
    run.small("sales_projections", proj)
    run.small("projection_summary", prj.projection_summary(proj, LAST_YEAR, HORIZON))
    run.commit()
    return read_export(spark, root, name)


# exports as files: what a user uploads

INDEX = {"Index": "title_key"}


def q_ingest_multiline(spark, d):
    """An export whose cells hold line breaks, quotes and commas, found as the
    second of two paths and read by many tasks."""
    path = shared_dir(spark, "multiline")
    imprint = "concat('\"', imprint, '\",\n\nHouse ', row_id % 10, if(row_id % 7 = 0, '\n', ''))"
    headers = INDEX | KEYS | {"Imprint": imprint}
    headers |= {SALES_HEADER.format(y=y): money_render_sql(sales_col(y), f"(row_id + {y}) % 8", 4) for y in YEARS}
    _write_export(catalog(spark, d).titles, headers, path)
    raw = csvc.read_first(spark, [f"{path}-of-another-day", path], years=YEARS, splittable=True)
    cur = csvc.curate(raw)
    return cur.title_year(carry=["title_key", "imprint"]).select("title_key", "imprint", "year", "net_sales")


def _write_export(titles, headers: dict[str, str], path: str) -> None:
    cols = [f"{e} AS `{h}`" for h, e in headers.items()]
    titles.selectExpr(*cols).write.options(header="true", escape='"', ignoreLeadingWhiteSpace="false",
                                           ignoreTrailingWhiteSpace="false").csv(path)


def q_malformed_records(spark, d):
    """Records with cells beyond the header, the first of them empty, and their
    cells, by the kind of fault; those left are curated."""
    path = shared_dir(spark, "malformed")
    headers = INDEX | KEYS | {f"Net Sales $ {LAST_YEAR}": _text(sales_col(LAST_YEAR))}
    record = f"concat_ws(',', {', '.join(headers.values())})"
    line = f"CASE WHEN row_id % 11 = 0 THEN concat({record}, ',,extra') WHEN row_id % 13 = 0 THEN concat({record}, ',\"a,b\",c,d') ELSE {record} END"
    # the records as they stand: neither quoted nor escaped
    out = catalog(spark, d).titles.selectExpr(f"{line} AS `{','.join(headers)}`")
    out.write.options(header="true", sep="\u0001", quote="").csv(path)
    raw = csvc.read_catalog(spark, path, years=YEARS, splittable=True)
    bad = csvc.malformed(raw).groupBy("fault", "n_cells").agg(F.count(F.lit(1)).alias("n_records"))
    kept = csvc.curate(raw, malformed="drop").titles
    return bad.unionByName(kept.agg(F.lit("none").alias("fault"), F.lit(len(headers)).alias("n_cells"),
                                    F.count(F.lit(1)).alias("n_records")))


def q_curate_observed(spark, d):
    """The numbers of ``validate_numeric``, observed while the titles are
    written."""
    headers = KEYS | {f"Net Sales $ {y}": money_render_sql(sales_col(y), f"(row_id + {y}) % 8", 4) for y in YEARS}
    _, report, cur = csvc.curate_to(_numbered(catalog(spark, d).titles, headers), shared_dir(spark, "observed"))
    numeric = report.where("check = 'numeric_content'")
    return numeric.select(F.regexp_extract("column", "([0-9]{4})", 1).cast("int").alias("year"), "severity", "n_bad",
                          "n_rows", cur.titles.agg(F.count(F.lit(1))).scalar().alias("n_curated"))


def q_validation_failures(spark, d):
    """An export without sales columns, and one without rows."""
    titles = catalog(spark, d).titles
    bare = csvc.validate(_numbered(titles, KEYS))[1]
    headers = KEYS | {f"Net Sales $ {LAST_YEAR}": _text(sales_col(LAST_YEAR))}
    empty = csvc.validate(_numbered(titles.where("fiscal_year < 0"), headers))[1]
    return bare.select(F.lit("bare").alias("export"), "check", "severity", "n_bad", "n_rows").unionByName(
        empty.select(F.lit("empty").alias("export"), "check", "severity", "n_bad", "n_rows"))


def q_column_fill(spark, d):
    """Column inventory: each column's role and filled cells."""
    headers = KEYS | {"Edition Status": "edition_status", "CoPub": "copub"}
    headers |= {f"Net Sales $ {y}": f"CASE WHEN {sales_col(y)} > 0 THEN {_text(sales_col(y))} ELSE 'N/A' END" for y in YEARS}
    return csvc.column_fill(_numbered(catalog(spark, d).titles, headers))


def q_date_layouts(spark, d):
    """Ship dates with the month first, with the day first, and a fifth of them
    the other way: each column is read by the layout that most of it fits."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    s, fifth = F.col("l_shipdate"), F.col("l_orderkey") % 5 == 0
    month, day = F.date_format(s, "M/d/yyyy"), F.date_format(s, "d/M/yyyy")
    text = {"month_first": month, "day_first": day, "mixed": F.when(fifth, month).otherwise(day)}
    won = elect_layouts(li, text)
    return li.select("l_orderkey", "l_linenumber", *[
        F.date_format(parse_elected(c, won[k].formats), "yyyy-MM-dd").alias(k) for k, c in text.items()])


# series of any length: reported in whole units, as sums over many points differ more

ORDER_LAST = LAST_YEAR * 12 + 11   # months since year 0
ORDER_ORIGIN = 1998 * 12 + 6
SHIP_LAST, SHIP_ORIGIN = "2001-12-31", "1998-06-30"


def _day(text: str) -> int:
    return (dt.date.fromisoformat(text) - dt.date(1970, 1, 1)).days


def q_projections_monthly(spark, d):
    """Monthly order values by priority, fitted and smoothed."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month")
    series = orders.groupBy("o_orderpriority", month).agg(fixed_sum(fixed_point("o_totalprice", 2), 2).alias("total_sales"))
    return _reported(lng.project_series(series, ["o_orderpriority"], period="month", value="total_sales", origin=ORDER_ORIGIN,
                                        last=ORDER_LAST, horizon=12), 1.0)


def q_projections_daily(spark, d):
    """Daily sales of the whole portfolio: some 2,500 points in one series."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    units = fixed_point("l_extendedprice", 2) * fixed_point(F.lit(1.0) - F.col("l_discount"), 2)
    series = li.groupBy(F.unix_date(F.col("l_shipdate").cast("date")).alias("day")).agg(fixed_sum(units, 4).alias("total_sales"))
    return _reported(lng.project_series(series, period="day", value="total_sales", origin=_day(SHIP_ORIGIN),
                                        last=_day(SHIP_LAST), horizon=30), 1.0)


QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def q_quantile_sketch(spark, d):
    """Quantiles of the line items' prices from one sketch per ship year, merged,
    and whether their ranks are within the stated error."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    by_year = li.groupBy(F.year("l_shipdate").alias("year")).agg(sketches.sketch("l_extendedprice").alias("s"))
    estimates = by_year.agg(sketches.merged("s").alias("s")).select(sketches.quantiles("s", QUANTILES)).first()[0]
    rank, slack = F.col("p") * F.col("n"), F.lit(2 * sketches.rank_error()) * F.col("n") + F.lit(1)
    return sketches.rank_span(li, "l_extendedprice", QUANTILES, estimates).select(
        "p", "n", (F.col("below").cast("double") <= rank + slack).alias("low_enough"),
        (F.col("upto").cast("double") >= rank - slack).alias("high_enough"))


# ---------------------------------------------------------------- registry

def _dims(spark, d):
    return [s for _, s in DIMENSIONS]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources / functions
    "ingest_catalog": q_ingest_catalog,
    "validate_numeric": q_validate_numeric,
    "parse_money": q_parse_money,
    "parse_quantity": q_parse_quantity,
    "parse_dates": q_parse_dates,
    "parse_number": q_parse_number,
    "type_names": q_type_names,
    "loose_roles": q_loose_roles,
    "explicit_roles": q_explicit_roles,
    "latest_by_role": q_latest_by_role,
    "validation_report": q_validation_report,
    "ingest_multiline": q_ingest_multiline,
    "malformed_records": q_malformed_records,
    "curate_observed": q_curate_observed,
    "validation_failures": q_validation_failures,
    "column_fill": q_column_fill,
    "date_layouts": q_date_layouts,
    "quantile_sketch": q_quantile_sketch,
    "projection_sink": q_projection_sink,
    "projection_summary_sink": lambda s, d: q_projection_sink(s, d, "projection_summary"),
    "series_sink": q_series_sink,
    "dataset_sink": q_dataset_sink,
    "title_key": q_title_key,
    "title_year": lambda s, d: catalog(s, d).title_year(),
    "preview": lambda s, d: tit.preview(catalog(s, d).titles),
    # series
    "yearly_summary": lambda s, d: yearly(s, d),
    "yearly_by_category": lambda s, d: yearly(s, d, ["book_type"]),
    "yoy_growth": lambda s, d: ser.yoy_growth(yearly(s, d)),
    "yoy_growth_later_years": lambda s, d: ser.yoy_growth(yearly(s, d), drop_first=True),
    "growth_text": q_growth_text,
    "growth_insights": lambda s, d: ser.growth_insights(yearly(s, d)),
    "portfolio_kpis": lambda s, d: ser.portfolio_kpis(catalog(s, d), yearly(s, d)),
    "analysis_summary": lambda s, d: ser.analysis_summary(ser.portfolio_kpis(catalog(s, d), yearly(s, d))),
    # categories
    "category_analysis": lambda s, d: cat.category_analysis(latest(s, d), _dims(s, d)),
    "editor_metrics": lambda s, d: cat.editor_metrics(latest(s, d)),
    "editor_top10": lambda s, d: cat.editor_top10(latest(s, d)),
    "edition_status_counts": lambda s, d: cat.edition_status_counts(latest(s, d)),
    "edition_status_sales": lambda s, d: cat.edition_status_sales(latest(s, d)),
    "format_performance": lambda s, d: cat.format_performance(latest(s, d)),
    "catalog_position": lambda s, d: cat.catalog_position(latest(s, d)),
    "legacy_performance": lambda s, d: cat.legacy_performance(latest(s, d)),
    "investment_groups": lambda s, d: cat.investment_groups(latest(s, d)),
    "copub_comparison": lambda s, d: cat.copub_comparison(latest(s, d)),
    "top_disciplines": lambda s, d: cat.top_disciplines(latest(s, d)),
    # titles
    "top_titles": lambda s, d: tit.top_titles(latest(s, d)),
    "sales_histogram": lambda s, d: tit.sales_histogram(latest(s, d)),
    "quartile_comparison": lambda s, d: tit.quartile_comparison(latest(s, d)),
    "pubyear_performance": lambda s, d: tit.pubyear_performance(latest(s, d), LAST_YEAR),
    # projections
    "projections_linear": lambda s, d: _project(s, d, methods=["linear"]),
    "projections_polynomial": lambda s, d: _project(s, d, methods=["polynomial"]),
    "projections_exponential": lambda s, d: _project(s, d, methods=["exponential_smoothing"]),
    "projections_all": lambda s, d: _project(s, d),
    "projection_confidence": lambda s, d: _reported(prj.project_confidence_levels(
        yearly(s, d), years=YEARS, last_year=LAST_YEAR, horizon=HORIZON)),
    "projections_by_category": lambda s, d: _project(s, d, ["book_type"]),
    "projections_by_title": lambda s, d: _reported(prj.project_titles(catalog(s, d), last_year=LAST_YEAR,
                                                                      horizon=HORIZON)),
    "projection_summary": lambda s, d: prj.projection_summary(_project(s, d), LAST_YEAR, HORIZON),
    "projections_monthly": q_projections_monthly,
    "projections_daily": q_projections_daily,
    "projection_overlay": q_projection_overlay,
}

FLAGSHIP = "projections_all"
