"""Catalog CSV exports: read, validate, curate.

Exports have quoted multi-line headers (``" Net Sales $ \\n2024 "``), money
text, accounting negatives and missing-value words.  Everything is read as
text with positional internal names (``_c<i>``) so that duplicate or
case-only-different headers never collide, then parsed by column role.
Spark reads a multi-line CSV file in one task; ``splittable`` reads it with
many (``sources.records``).

Malformed records are kept: ``_fault`` names what is wrong with a record and
``_corrupt`` holds its text.  ``malformed`` lists them, ``validate`` counts
them, and ``curate`` fails on them or leaves them out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from backlist.functions.clean import (
    not_money_sql, null_words_sql, parse_date, parse_money_sql, parse_number, parse_quantity_sql,
)
from backlist.functions.layouts import elect_layouts, parse_elected
from backlist.plans.ordinal import with_file_ordinal, with_ordinal
from backlist.sources.catalog import Catalog, qty_col, sales_col
from backlist.sources.records import quote_count, read_lines, read_records
from backlist.sources.roles import (
    DEFAULT_YEARS, DIMENSIONS, QTY_MARKER, SALES_MARKER, ColumnRoles, column_role, dedup_names, detect_roles,
)

CORRUPT, FAULT = "_corrupt", "_fault"
CSV_OPTIONS = {"multiLine": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
# what can be wrong with a record, and how the report puts it; a record with
# fewer cells than the header is not malformed: the rest are missing values
FAULTS = {"surplus_cells": "have cells beyond the header", "unclosed_quote": "have a quote that is never closed",
          "stray_quote": "have a line break after a quote inside a cell"}
REQUIRED = ("WorkRef", "PubDate", "FiscalYearOfPublication")


class CatalogError(ValueError):
    """Raised instead of silently substituting other data."""


@dataclass(frozen=True)
class RawCatalog:
    """All-text catalog: ``df`` has ``row_id`` and ``_c<i>`` STRING columns
    (missing-value words already NULL); ``roles.names[i]`` names ``_c<i>``.
    Catalogs read from files have ``_fault`` and ``_corrupt``; ``lines`` are
    the files' lines where their quotes are still to be counted."""

    df: DataFrame
    roles: ColumnRoles
    source: str
    lines: DataFrame | None = None

    def cell(self, name: str) -> str:
        return f"_c{self.roles.position(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.cell(name))


def read_header(spark: SparkSession, path: str | Sequence[str]) -> list[str | None]:
    """The header record of the (first) file, parsed as data on the driver."""
    first = spark.read.options(header="false", **CSV_OPTIONS).csv(path).limit(1).collect()
    if not first:
        raise CatalogError(f"no header record in {path}")
    return list(first[0])


def cell_count(record: Column) -> Column:
    """Cells of a record's text: one more than its commas outside quotes."""
    bare = F.regexp_replace(record, '"[^"]*+(?:"|$)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + F.lit(1)


# a record whose quotes all stand where cells begin and end, or are doubled
_SOUND_QUOTES = (r'^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+$')


def _fault(width: int, text: Column | None = None) -> Column:
    """The fault of a record; ``text`` is every record's text, where it is at
    hand, and not only that of records with another number of cells."""
    # Spark refuses to read a file's corrupt records alone, so a cell goes along
    known = F.concat(F.col(CORRUPT), F.left(F.coalesce("_c0", F.lit("")), F.lit(0))) if text is None else text
    fault = F.when(quote_count(known) % 2 == 1, "unclosed_quote")
    if text is not None:
        fault = fault.when(F.contains(text, F.lit("\n")) & ~text.rlike(_SOUND_QUOTES), "stray_quote")
    return fault.when(cell_count(F.col(CORRUPT) if text is not None else known) > width, "surplus_cells")


def read_catalog(spark: SparkSession, path: str | Sequence[str], years: Sequence[int] = DEFAULT_YEARS,
                 mode: str = "strict", sales: Sequence[str] | None = None,
                 quantity: Sequence[str] | None = None, splittable: bool = False) -> RawCatalog:
    """Every file's header must equal the first file's; a job over files with
    another one fails and names the file.  ``splittable`` reads every file with
    many tasks, also if quoted cells hold line breaks: its records are written
    to the shared folder first.  A quote inside an unquoted cell is text to the
    reader of whole files; to the splittable one it opens a quotation, and what
    that swallows is reported as a fault."""
    header = read_header(spark, path)
    names = [n.strip() for n in dedup_names(header)]
    cells = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, CORRUPT]])
    options = CSV_OPTIONS | {"columnNameOfCorruptRecord": CORRUPT}
    lines = None
    if splittable:
        parsed = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options)
        rows = read_records(spark, path).select("file", "start", "rec", "text", parsed.alias("c"))
        rows = rows.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("rec").alias("_pos"), "c.*", "text")
        fault = _fault(len(names), F.col("text"))
        scan = rows.select("_file", "_start", "_pos", *cells, F.when(fault.isNotNull(), F.col("text")).alias(CORRUPT),
                           fault.alias(FAULT))
        df = with_ordinal(scan, "row_id", header=True)
    else:
        scan = spark.read.schema(schema).options(header="false", **options).csv(path)
        df = with_file_ordinal(scan, "row_id", header=True).withColumn(FAULT, _fault(len(names)))
        df = df.withColumn(CORRUPT, F.when(F.col(FAULT).isNotNull(), F.col(CORRUPT)))
        lines = read_lines(spark, path)
    df = df.selectExpr("row_id", *[f"{null_words_sql(c)} AS {c}" for c in cells], FAULT, CORRUPT)
    roles = detect_roles(names, years, mode=mode, sales=sales, quantity=quantity)
    return RawCatalog(df, roles, str(path), lines)


def malformed(raw: RawCatalog) -> DataFrame:
    """``(row_id, fault, n_cells, record)`` of every malformed record; n_cells
    counts the cells of its text."""
    return raw.df.where(F.col(FAULT).isNotNull()).select("row_id", F.col(FAULT).alias("fault"),
                                                         cell_count(F.col(CORRUPT)).alias("n_cells"),
                                                         F.col(CORRUPT).alias("record"))


def read_first(spark: SparkSession, paths: Sequence[str], **kw) -> RawCatalog:
    """The first path that exists; only "path not found" moves on to the next."""
    for p in paths:
        try:
            return read_catalog(spark, p, **kw)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                continue
            raise
    raise CatalogError(f"none of {list(paths)} exists")


REPORT_SCHEMA = "check string, severity string, column string, n_bad bigint, n_rows bigint, message string"


def _header_report(raw: RawCatalog) -> list[tuple]:
    """The report's rows that follow from the header alone."""
    names, out = raw.roles.names, []
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        out.append(("required_columns", "error", None, None, None, f"missing required columns: {missing}"))
    if not any(SALES_MARKER in c for c in names):
        out.append(("sales_columns", "error", None, None, None, f"no '{SALES_MARKER}' columns found"))
    elif not raw.roles.sales:
        out.append(("sales_years", "error", None, None, None,
                    f"no '{SALES_MARKER}' column names a year in {raw.roles.years[0]}..{raw.roles.years[-1]}"))
    if not any(QTY_MARKER in c for c in names):
        out.append(("quantity_columns", "warn", None, None, None, "no quantity columns found"))
    return out + [("roles", "warn", None, None, None, w) for w in raw.roles.warnings]


def _measures(raw: RawCatalog) -> list[Column]:
    """What one pass counts: rows ``n``, each fault ``f<i>``, and per sales
    column ``b<i>`` the non-blank cells that do not parse as money."""
    has = FAULT in raw.df.columns
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.count_if(F.col(FAULT) == k if has else F.lit(False)).alias(f"f{i}") for i, k in enumerate(FAULTS)]
    return out + [F.expr(f"count_if({not_money_sql(raw.cell(c))}) AS b{i}") for i, c in enumerate(raw.roles.sales)]


def _measured_report(raw: RawCatalog, stats: DataFrame) -> DataFrame:
    """The report's rows that follow from the one row of ``_measures``."""
    def entry(check, severity, column, n_bad, message):
        return F.struct(F.lit(check).alias("check"), severity.alias("severity"), F.lit(column).cast("string").alias("column"),
                        n_bad.cast("bigint").alias("n_bad"), F.col("n").cast("bigint").alias("n_rows"), message.alias("message"))

    found = [F.when(F.col("n") == 0, entry("empty", F.lit("error"), None, F.lit(None), F.lit("the file is empty")))]
    for i, (k, says) in enumerate(FAULTS.items()):
        bad = F.col(f"f{i}")
        found.append(F.when(bad > 0, entry(k, F.lit("error"), None, bad, F.format_string(f"%d of %d rows {says}", bad, F.col("n")))))
    for i, c in enumerate(raw.roles.sales):
        bad = F.col(f"b{i}")
        found.append(entry("numeric_content", F.when(bad > 0, "warn").otherwise("ok"), c, bad,
                           F.format_string("%d of %d cells are not numbers (read as 0)", bad, F.col("n"))))
    return stats.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def _open_files(lines: DataFrame) -> DataFrame:
    """A warning if files have an odd number of quotes: read whole, a quote that
    is never closed takes all that follows into one cell."""
    files = lines.groupBy("file").agg((F.sum(quote_count(F.col("line"))) % 2).alias("odd"))
    n = files.agg(F.count_if(F.col("odd") == 1).alias("bad"), F.count(F.lit(1)).alias("n"))
    return n.where("bad > 0").select(
        F.lit("odd_quotes").alias("check"), F.lit("warn").alias("severity"), F.lit(None).cast("string").alias("column"),
        F.col("bad").alias("n_bad"), F.col("n").alias("n_rows"),
        F.format_string("%d of %d files have an odd number of quotes: a quote may never be closed", "bad", "n").alias("message"))


def validate(raw: RawCatalog) -> tuple[bool, DataFrame]:
    """Structural checks of the header, and one pass that counts rows, malformed
    records, and per sales column non-blank cells that do not parse as money.
    Headers are stripped before checking.  Returns ``(ok, report)``: ``ok`` is
    False if the header has errors; the report is lazy, and its rows ``empty``
    and ``FAULTS`` are errors of the data (``data_errors`` runs it for them)."""
    meta = _header_report(raw)
    report = raw.df.sparkSession.createDataFrame(meta, REPORT_SCHEMA)
    report = report.unionByName(_measured_report(raw, raw.df.agg(*_measures(raw))))
    if raw.lines is not None:
        report = report.unionByName(_open_files(raw.lines))
    return not any(r[1] == "error" for r in meta), report


DATA_ERRORS = ("empty", *FAULTS)


def data_errors(report: DataFrame) -> list[str]:
    """Messages of the errors that a pass over the data found (runs it)."""
    return [r["message"] for r in report.where(F.col("check").isin(*DATA_ERRORS)).collect()]


def curate_to(raw: RawCatalog, path: str, malformed: str = "fail", **options) -> tuple[bool, DataFrame, Catalog | None]:
    """Curates into ``path`` (Parquet) and validates in the same pass: what
    ``validate`` counts is observed while the titles are written, so the export
    is parsed once.  Returns ``(ok, report, catalog)``; with errors in the
    header nothing is written, and with errors in the data the catalog is None
    (``malformed="drop"``: only if the export is empty), whatever lies at the
    path."""
    spark = raw.df.sparkSession
    meta = _header_report(raw)
    if any(r[1] == "error" for r in meta):
        return False, spark.createDataFrame(meta, REPORT_SCHEMA), None
    seen = Observation()
    cur = curate(replace(raw, df=raw.df.observe(seen, *_measures(raw))), malformed="drop", **options)
    cur.titles.write.mode("overwrite").parquet(path)
    names = ["n", *(f"f{i}" for i in range(len(FAULTS))), *(f"b{i}" for i in range(len(raw.roles.sales)))]
    stats = spark.createDataFrame([tuple(seen.get[c] for c in names)], ", ".join(f"{c} bigint" for c in names))
    report = spark.createDataFrame(meta, REPORT_SCHEMA).unionByName(_measured_report(raw, stats))
    if raw.lines is not None:
        report = report.unionByName(_open_files(raw.lines))
    counts = seen.get
    bad = counts["n"] == 0 or malformed == "fail" and any(counts[f"f{i}"] for i in range(len(FAULTS)))
    return not bad, report, None if bad else cur.with_titles(spark.read.schema(cur.titles.schema).parquet(path))


def column_fill(raw: RawCatalog) -> DataFrame:
    """Column inventory with the data's share in it: ``position, column, role,
    n_rows, n_filled``, counted in one pass."""
    names = raw.roles.names
    stats = raw.df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"_c{i}").alias(f"c{i}") for i in range(len(names))])
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(column_role(raw.roles, c)).alias("role"),
                 F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_filled")) for i, c in enumerate(names)])))


def synthetic_key(work_ref: Column | None, ordinal: Column) -> Column:
    """``<WorkRef>_<row ordinal>`` (a missing WorkRef reads ``nan``), or the
    ordinal alone when there is no WorkRef column."""
    if work_ref is None:
        return ordinal.cast("string")
    return F.concat_ws("_", F.coalesce(work_ref, F.lit("nan")), ordinal.cast("string"))


def snake(name: str) -> str:
    out = "".join(ch.lower() if ch.isalnum() else "_" for ch in name.strip())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


def curate(raw: RawCatalog, strict: bool = True, dates: Sequence[str] = (),
           numeric_dims: Sequence[str] = (), malformed: str = "fail", column_layouts: bool = False) -> Catalog:
    """Typed wide titles table from the text catalog (lazy).

    ``column_layouts``: date columns are read by one layout each, elected by
    all cells (``functions.layouts``; runs one aggregate), instead of cell by
    cell with the month first.

    ``malformed``: a malformed record fails the job that reads the titles
    (``fail``, the message has its row and fault) or is left out (``drop``;
    ``validate`` and ``curate_to`` count them).

    ``dates``: further columns to parse as dates (an explicit role map's date
    columns), added as ``<snake_name>_date``.  ``numeric_dims``: category
    columns (export names) whose numeric-looking values are keyed by number,
    so ``1`` and ``1.0`` form one group (the export's spreadsheet typing);
    other values stay text.
    """
    r = raw.roles
    if malformed not in ("fail", "drop"):
        raise ValueError(f"malformed must be 'fail' or 'drop', not {malformed!r}")
    if strict:
        problems = [c for c in REQUIRED if not r.has(c)]
        if problems or not r.sales:
            raise CatalogError(f"cannot curate {raw.source}: missing {problems or 'sales columns'}")
    if r.has("Index"):
        key = raw.col("Index")
    else:
        key = synthetic_key(raw.col("WorkRef") if r.has("WorkRef") else None, F.col("row_id"))
    cols = [F.col("row_id"), key.alias("title_key")]
    cols.append((raw.col("WorkRef") if r.has("WorkRef") else F.lit(None).cast("string")).alias("work_ref"))
    dims = []
    for label, name in DIMENSIONS:
        if r.has(label):
            c = raw.col(label)
            if label in numeric_dims:
                num = parse_number(c)
                c = F.when(num.isNotNull(), num.cast("string")).otherwise(c)
            cols.append(c.alias(name))
            dims.append(name)
    if r.has("Imprint"):
        cols.append(raw.col("Imprint").alias("imprint"))
    named = [d for d in dict.fromkeys(["PubDate", *dates]) if r.has(d)]
    layouts = elect_layouts(raw.df, {d: raw.col(d) for d in named}) if column_layouts else {}
    for d in named:
        date = parse_elected(raw.col(d), layouts[d].formats) if column_layouts else parse_date(raw.col(d))
        cols.append(date.alias("pub_date" if d == "PubDate" else f"{snake(d)}_date"))
    if "PubDate" not in named:
        cols.append(F.lit(None).cast("date").alias("pub_date"))
    fy = parse_number(raw.col("FiscalYearOfPublication")) if r.has("FiscalYearOfPublication") \
        else F.lit(None).cast("double")
    cols.append(F.when(fy == F.floor(fy), fy.try_cast("int")).alias("fiscal_year"))
    sales_map, qty_map = r.sales_by_year, r.quantity_by_year
    years = tuple(sorted(sales_map))
    for y in years:
        cols.append(F.expr(f"{parse_money_sql(raw.cell(sales_map[y]))} AS {sales_col(y)}"))
        cols.append(F.expr(f"{parse_quantity_sql(raw.cell(qty_map[y])) if y in qty_map else '0.0D'} AS {qty_col(y)}"))
    latest = r.latest_sales()
    if latest is not None:
        cols.append(F.expr(f"{parse_money_sql(raw.cell(latest[1]))} AS latest_sales"))
    else:
        cols.append(F.lit(None).cast("double").alias("latest_sales"))
    rows = raw.df
    if FAULT in rows.columns and malformed == "drop":
        rows = rows.where(F.col(FAULT).isNull())
    elif FAULT in rows.columns:
        rows = rows.where(F.when(F.col(FAULT).isNull(), True).otherwise(F.raise_error(F.format_string(
            f"{raw.source.replace('%', '%%')}: malformed record (%s) in row %d", FAULT, "row_id")).cast("boolean")))
    titles = rows.select(*cols)
    return Catalog(titles, years, latest[0] if latest else None, tuple(dims), r.warnings)
