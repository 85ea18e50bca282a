"""DuckDB SQL oracles for ``backlist.registry.QUERIES``.

Written independently of the Spark plans (long-form densification by cross
join, window ranks instead of file ordinals...), with explicit casts so
types line up: DuckDB's ``count_if`` is HUGEINT, ``year()`` BIGINT and
decimal literals are DECIMAL, so every such value is cast.
"""

from __future__ import annotations

from backlist.registry import (
    FIRST_YEAR, HORIZON, LAST_YEAR, ORDER_LAST, ORDER_ORIGIN, QUANTILES, SHIP_LAST, SHIP_ORIGIN, YEARS, _day,
)

L = LAST_YEAR


def msum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,12))) AS DOUBLE)"


def r2(x: str) -> str:
    return f"round_even(({x}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE"


BASE = f"""
facts AS (
  SELECT l_partkey AS row_id, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net_sales,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS net_qty
  FROM lineitem
  WHERE l_shipdate >= DATE '{FIRST_YEAR}-01-01' AND l_shipdate < DATE '{LAST_YEAR + 1}-01-01'
  GROUP BY 1, 2),
title_dim AS (
  SELECT p_partkey AS row_id,
         concat('w', p_partkey, '_', p_partkey) AS title_key,
         concat('w', p_partkey) AS work_ref,
         CASE WHEN p_partkey % 2 = 0 THEN 'a. Print' ELSE 'b. eBook' END AS reporting_type,
         p_type AS book_type, p_brand AS discipline,
         concat('Editor ', p_size) AS acquisition_editor,
         CASE p_size % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Revised' WHEN 2 THEN 'Reissue' END AS edition_status,
         concat('Format ', p_size % 7) AS reporting_product_type,
         concat('Slot ', p_size % 5) AS catalog_position,
         CASE WHEN p_size > 40 THEN 'Y' ELSE 'N' END AS legacy_library,
         CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS copub,
         concat('Class ', p_partkey % 3) AS title_counts_type,
         split_part(p_name, ' ', 2) AS ip_book_type,
         concat('Group ', p_partkey % 6) AS high_investment_group,
         concat('Publisher ', p_partkey % 9) AS imprint,
         make_date(1980 + p_size, 1 + p_partkey % 12, 1 + p_partkey % 28) AS pub_date,
         CAST(1980 + p_size AS INTEGER) AS fiscal_year
  FROM part),
years AS (SELECT CAST(range AS INTEGER) AS year FROM range({FIRST_YEAR}, {LAST_YEAR + 1})),
title_year AS (
  SELECT d.row_id, y.year, COALESCE(f.net_sales, 0.0::DOUBLE) AS net_sales,
         COALESCE(f.net_qty, 0.0::DOUBLE) AS net_qty
  FROM title_dim d CROSS JOIN years y
  LEFT JOIN facts f ON f.row_id = d.row_id AND f.year = y.year),
latest AS (
  SELECT d.*, ty.net_sales AS sales
  FROM title_dim d JOIN title_year ty ON ty.row_id = d.row_id AND ty.year = {LAST_YEAR})
"""


def with_base(sql: str) -> str:
    return f"WITH {BASE}, {sql}"


YEARLY_BY = """
yearly AS (
  SELECT {keys}ty.year,
         {ts} AS total_sales, {tq} AS total_quantity,
         CAST(count_if(ty.net_sales > 0) AS BIGINT) AS active_titles
  FROM title_year ty {join}
  {where}
  GROUP BY {keys}ty.year),
series AS (
  SELECT {keys2}year, total_sales, total_quantity, active_titles,
         total_sales / greatest(active_titles, 1) AS revenue_per_title
  FROM yearly)
"""


def yearly_cte(key: str | None = None) -> str:
    if key is None:
        return YEARLY_BY.format(keys="", keys2="", join="", where="",
                                ts=msum("ty.net_sales"), tq=msum("ty.net_qty"))
    return YEARLY_BY.format(keys=f"d.{key}, ", keys2=f"{key}, ",
                            join="JOIN title_dim d ON d.row_id = ty.row_id",
                            where=f"WHERE d.{key} IS NOT NULL",
                            ts=msum("ty.net_sales"), tq=msum("ty.net_qty"))


SERIES_SELECT = "SELECT {keys}year, total_sales, total_quantity, active_titles, revenue_per_title FROM series"


# ------------------------------------------------------------------ projections

# The engine solves normal equations over positional columns; here the line is
# DuckDB's own regression, the parabola adds the part of x * x that the line
# leaves over, and smoothing is a recursive query.  Both sides report values in
# steps of 2 ** -10 (registry.GRID).

CONF = {"Conservative": 0.8, "Moderate": 1.0, "Optimistic": 1.2}
METRICS = ("total_sales", "total_quantity", "active_titles", "revenue_per_title")
LABELS = ("Linear", "Polynomial", "Exponential Smoothing")
MID = (FIRST_YEAR + LAST_YEAR) // 2


def series_points(k: str) -> str:
    return "points AS (" + " UNION ALL ".join(
        f"SELECT {k}year, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM series" for m in METRICS) + ")"


def title_points() -> str:
    sold = "CASE WHEN net_sales > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    values = ("net_sales", "net_qty", sold, f"net_sales / greatest({sold}, 1.0::DOUBLE)")
    return "points AS (" + " UNION ALL ".join(
        f"SELECT row_id, year, '{m}' AS metric, {v} AS v FROM title_year" for m, v in zip(METRICS, values)) + ")"


def proj_sql(k: str, levels=("Moderate",), labels=LABELS, mid=MID, last=L, horizon=HORIZON, grid=1024.0) -> str:
    """From ``points`` to ``proj(confidence, keys, method, metric, year, value)``."""
    ids = f"{k}metric"
    on = " AND ".join(f"r.{c.strip()} = s.{c.strip()}" for c in ids.split(","))
    return f"""
ranked AS (
  SELECT *, CAST(year - {mid} AS DOUBLE) AS x, row_number() OVER (PARTITION BY {ids} ORDER BY year) AS i FROM points),
line AS (
  SELECT {ids}, count(*) AS n, max(abs(v)) AS top, arg_max(v, year) AS y_last,
         regr_slope(v, x) AS b, regr_intercept(v, x) AS a, regr_slope(x * x, x) AS qb, regr_intercept(x * x, x) AS qa
  FROM ranked GROUP BY {ids} HAVING count(*) >= 2),
bend AS (
  SELECT {ids}, sum(q * v) / sum(q * q) AS c
  FROM (SELECT *, x * x - qa - qb * x AS q FROM ranked JOIN line USING ({ids})) GROUP BY {ids}),
smooth AS (
  SELECT {ids}, i, v AS level FROM ranked WHERE i = 1
  UNION ALL
  SELECT {', '.join('r.' + c.strip() for c in ids.split(','))}, r.i, 0.3::DOUBLE * r.v + 0.7::DOUBLE * s.level
  FROM smooth s JOIN ranked r ON r.i = s.i + 1 AND {on}),
ends AS (
  SELECT {ids}, max(CASE WHEN i = n THEN level END) AS s_n,
         (max(CASE WHEN i = n THEN level END) - max(CASE WHEN i = greatest(n - 2, 1) THEN level END))
           / CAST(max(least(n - 1, 2)) AS DOUBLE) AS trend
  FROM smooth JOIN line USING ({ids}) GROUP BY {ids}),
levels(confidence, m) AS (VALUES {', '.join(f"('{c}', {CONF[c]}::DOUBLE)" for c in levels)}),
methods(method) AS (VALUES {', '.join(f"('{x}')" for x in labels)}),
steps AS (SELECT CAST(range AS INTEGER) AS step, CAST(range + {last - mid} AS DOUBLE) AS x FROM range(1, {horizon + 1})),
model AS (
  SELECT *, y_last + (a + b * x + CASE WHEN method = 'Polynomial' AND n >= 3 THEN c * (x * x - qa - qb * x)
                                       ELSE 0.0::DOUBLE END - y_last) * m AS scaled
  FROM line JOIN bend USING ({ids}) JOIN ends USING ({ids}) CROSS JOIN levels CROSS JOIN methods CROSS JOIN steps),
proj AS (
  SELECT confidence, {k}method, metric, CAST({last} + step AS INTEGER) AS year,
         floor((CASE WHEN top = 0 THEN 0.0::DOUBLE
                     WHEN method = 'Exponential Smoothing' THEN greatest(0.0::DOUBLE, s_n + trend * m * step)
                     WHEN metric = 'revenue_per_title' THEN scaled
                     ELSE greatest(scaled, 0.0::DOUBLE) END) * {grid}::DOUBLE + 0.5::DOUBLE) / {grid}::DOUBLE AS value
  FROM model)"""


def projected(select: str, key: str | None = None, **kw) -> str:
    k = f"{key}, " if key else ""
    return f"WITH RECURSIVE {BASE}, {yearly_cte(key)}, {series_points(k)}, {proj_sql(k, **kw)} {select}"


PROJ = "SELECT {k}method, metric, year, value FROM proj"


# ------------------------------------------------------------------ the rest

def _money_render(v: str, p: str, dec: int) -> str:
    # the numbers the rendered text must parse back to
    return (f"CASE WHEN {v} IN (0, 1, 3) THEN {p} WHEN {v} IN (2, 7) THEN -({p}) ELSE 0.0::DOUBLE END")


def _dim_metrics(dim: str, mean: str = "avg_sales", count: str = "title_count", total_titles=False,
                 top: int | None = None, order_sales=True) -> str:
    tt = ", CAST(count(title_key) AS BIGINT) AS total_titles" if total_titles else ""
    tt_out = ", total_titles" if total_titles else ""
    order = f"ORDER BY total_sales DESC, {dim} ASC" if order_sales else f"ORDER BY {dim}"
    lim = f"LIMIT {top}" if top else ""
    return with_base(f"""g AS (SELECT {dim}, {msum('sales')} AS s, CAST(count(sales) AS BIGINT) AS {count}{tt}
          FROM latest WHERE {dim} IS NOT NULL GROUP BY {dim})
SELECT {dim}, {r2('s')} AS total_sales, {r2(f's / {count}')} AS {mean}, {count}{tt_out}
FROM g {order} {lim}""")


def _category_sql() -> str:
    from backlist.sources.roles import DIMENSIONS
    unions = " UNION ALL ".join(
        f"SELECT '{label}' AS dimension, CAST({snake} AS VARCHAR) AS category, sales FROM latest"
        for label, snake in DIMENSIONS)
    return with_base(f"""u AS ({unions}),
g AS (SELECT dimension, category, {msum('sales')} AS total_sales, CAST(count(*) AS BIGINT) AS title_count
      FROM u WHERE category IS NOT NULL GROUP BY dimension, category)
SELECT dimension, category, total_sales, title_count,
       total_sales / CASE WHEN title_count = 0 THEN 1 ELSE title_count END AS revenue_per_title FROM g""")


def _quantile(p: float) -> str:
    # numpy linear interpolation between order statistics at p*(n-1)
    pos = f"({p}::DOUBLE * CAST(nn.n - 1 AS DOUBLE))"
    lo = f"max(CASE WHEN rk = CAST(floor({pos}) AS BIGINT) THEN sales END)"
    hi = f"max(CASE WHEN rk = CAST(ceil({pos}) AS BIGINT) THEN sales END)"
    t = f"({pos} - floor({pos}))"
    return (f"CASE WHEN {t} >= 0.5::DOUBLE THEN {hi} - ({hi} - {lo}) * (1.0::DOUBLE - {t}) "
            f"ELSE {lo} + ({hi} - {lo}) * {t} END")


def _ingest_sql() -> str:
    s = _money_render("CAST((ty.row_id + ty.year) % 8 AS INTEGER)", "ty.net_sales", 4)
    q = ("CASE WHEN (ty.row_id + ty.year) % 5 = 0 AND ty.net_qty >= 1000 THEN 0.0::DOUBLE "
         "ELSE ty.net_qty END")
    return with_base(f"""x AS (SELECT 1) SELECT d.title_key, ty.year, {s} AS net_sales, {q} AS net_qty
FROM title_year ty JOIN title_dim d ON d.row_id = ty.row_id""")


ORACLE: dict[str, str] = {
    "ingest_catalog": _ingest_sql(),
    "validate_numeric": with_base(f"""x AS (SELECT 1)
SELECT year, CASE WHEN n_bad > 0 THEN 'warn' ELSE 'ok' END AS severity, n_bad, n_rows FROM (
  SELECT ty.year, CAST(count_if((ty.row_id + ty.year) % 8 IN (5, 6)) AS BIGINT) AS n_bad,
         CAST(count(*) AS BIGINT) AS n_rows
  FROM title_year ty GROUP BY ty.year) t"""),
    "parse_money": f"""SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 AS variant,
  {_money_render('(l_orderkey + l_linenumber) % 8', 'l_extendedprice', 2)} AS amount FROM lineitem""",
    "parse_quantity": """SELECT l_orderkey, l_linenumber,
  CASE (l_orderkey + 2 * l_linenumber) % 6
    WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity
    WHEN 2 THEN CASE WHEN l_quantity * 100 < 1000 THEN l_quantity * 100 ELSE 0.0::DOUBLE END
    WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE
    ELSE CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 10.0::DOUBLE ELSE 100.0::DOUBLE END
  END AS quantity FROM lineitem""",
    "parse_dates": """SELECT l_orderkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 5 IN (0, 1, 2) THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') END AS ship_date
  FROM lineitem""",
    "title_key": """SELECT p_partkey, concat(CASE WHEN p_partkey % 13 = 0 THEN 'nan' ELSE concat('w', p_partkey) END,
  '_', row_number() OVER (ORDER BY p_partkey) - 1) AS title_key FROM part""",
    "title_year": with_base("x AS (SELECT 1) SELECT row_id, year, net_sales, net_qty FROM title_year"),
    "preview": with_base("""x AS (SELECT 1) SELECT title_key, COALESCE(book_type, 'N/A') AS book_type,
  COALESCE(discipline, 'N/A') AS discipline, COALESCE(imprint, 'N/A') AS imprint
  FROM title_dim ORDER BY row_id LIMIT 3"""),
    "yearly_summary": with_base(f"{yearly_cte()} {SERIES_SELECT.format(keys='')}"),
    "yearly_by_category": with_base(f"{yearly_cte('book_type')} {SERIES_SELECT.format(keys='book_type, ')}"),
    "yoy_growth": with_base(f"""{yearly_cte()} SELECT year, total_sales, active_titles,
  (total_sales / NULLIF(lag(total_sales) OVER (ORDER BY year), 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE AS sales_growth,
  (CAST(active_titles AS DOUBLE) / NULLIF(CAST(lag(active_titles) OVER (ORDER BY year) AS DOUBLE), 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE AS titles_growth
  FROM series"""),
    "growth_insights": with_base(f"""{yearly_cte()},
g AS (SELECT year, total_sales,
  (total_sales / NULLIF(lag(total_sales) OVER (ORDER BY year), 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE AS sales_growth
  FROM series)
SELECT CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year,
  CAST(count(*) AS BIGINT) AS n_years,
  CASE WHEN count(*) > 1 THEN (arg_max(total_sales, year) - arg_min(total_sales, year)) / NULLIF(arg_min(total_sales, year), 0.0::DOUBLE) * 100.0::DOUBLE END AS total_growth_pct,
  CASE WHEN count(*) > 1 THEN round_even(avg(sales_growth) * 1e9::DOUBLE, 0) / 1e9::DOUBLE END AS avg_growth_pct
FROM g"""),
    "portfolio_kpis": with_base(f"""{yearly_cte()},
r AS (SELECT *, row_number() OVER (ORDER BY year DESC) AS rn FROM series),
k AS (SELECT max(CASE WHEN rn = 1 THEN year END) AS latest_year,
             max(CASE WHEN rn = 1 THEN total_sales END) AS latest_sales,
             max(CASE WHEN rn = 2 THEN total_sales END) AS prev,
             max(CASE WHEN rn = 1 THEN active_titles END) AS active_titles,
             max(CASE WHEN rn = 1 THEN revenue_per_title END) AS revenue_per_title FROM r)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM title_dim) AS total_titles, latest_year, latest_sales,
  (latest_sales - prev) / NULLIF(prev, 0.0::DOUBLE) * 100.0::DOUBLE AS sales_growth_pct,
  active_titles, revenue_per_title FROM k"""),
    "analysis_summary": with_base(f"""{yearly_cte()},
k AS (SELECT arg_max(total_sales, year) AS s, arg_max(active_titles, year) AS a,
             arg_max(revenue_per_title, year) AS r FROM series)
SELECT 'Total Titles' AS metric, CAST((SELECT count(*) FROM title_dim) AS DOUBLE) AS value
UNION ALL SELECT 'Latest Year Sales', COALESCE(s, 0.0::DOUBLE) FROM k
UNION ALL SELECT 'Active Titles', COALESCE(CAST(a AS DOUBLE), 0.0::DOUBLE) FROM k
UNION ALL SELECT 'Revenue per Title', COALESCE(r, 0.0::DOUBLE) FROM k"""),
    "category_analysis": _category_sql(),
    "editor_metrics": _dim_metrics("acquisition_editor", "avg_sales_per_title", "active_titles", True, 15),
    "editor_top10": with_base(f"""g AS (SELECT acquisition_editor, {msum('sales')} AS s, CAST(count(sales) AS BIGINT) AS active_titles,
          CAST(count(title_key) AS BIGINT) AS total_titles FROM latest WHERE acquisition_editor IS NOT NULL
          GROUP BY acquisition_editor),
t AS (SELECT acquisition_editor, {r2('s')} AS ts, {r2('s / active_titles')} AS av, active_titles, total_titles
      FROM g ORDER BY ts DESC, acquisition_editor LIMIT 10)
SELECT acquisition_editor, '$' || format('{{:,.0f}}', ts) AS total_sales,
       '$' || format('{{:,.0f}}', av) AS avg_sales_per_title, active_titles, total_titles FROM t"""),
    "edition_status_counts": with_base("""x AS (SELECT 1) SELECT edition_status, CAST(count(*) AS BIGINT) AS title_count
  FROM latest WHERE edition_status IS NOT NULL GROUP BY edition_status"""),
    "edition_status_sales": with_base(f"""x AS (SELECT 1) SELECT edition_status, {msum('sales')} AS total_sales
  FROM latest WHERE edition_status IS NOT NULL GROUP BY edition_status"""),
    "format_performance": _dim_metrics("reporting_product_type", "avg_sales", "active_titles", True),
    "catalog_position": _dim_metrics("catalog_position"),
    "legacy_performance": _dim_metrics("legacy_library", order_sales=False),
    "investment_groups": _dim_metrics("high_investment_group", order_sales=False),
    "copub_comparison": with_base(f"""g AS (SELECT CAST(count_if(copub = 'Yes') AS BIGINT) AS copub_titles,
    CAST(count_if(copub = 'No') AS BIGINT) AS non_copub_titles,
    {msum("CASE WHEN copub = 'Yes' THEN sales END")} AS sy, {msum("CASE WHEN copub = 'No' THEN sales END")} AS sn
  FROM latest)
SELECT copub_titles, non_copub_titles,
  CASE WHEN copub_titles > 0 AND non_copub_titles > 0 THEN {r2('sy / copub_titles')} END AS copub_avg_sales,
  CASE WHEN copub_titles > 0 AND non_copub_titles > 0 THEN {r2('sn / non_copub_titles')} END AS non_copub_avg_sales
FROM g"""),
    "top_disciplines": with_base(f"""x AS (SELECT 1) SELECT discipline, {msum('sales')} AS total_sales
  FROM latest WHERE discipline IS NOT NULL GROUP BY discipline ORDER BY total_sales DESC, discipline LIMIT 3"""),
    "top_titles": with_base("""x AS (SELECT 1) SELECT title_key, imprint, book_type, discipline, fiscal_year, sales,
  '$' || format('{:,.0f}', sales) AS sales_text FROM latest ORDER BY sales DESC, row_id LIMIT 20"""),
    "sales_histogram": with_base("""st AS (SELECT min(sales) AS lo, max(sales) AS hi FROM latest),
b AS (SELECT CAST(CASE WHEN hi - lo > 0 THEN least(floor((sales - lo) * 30.0::DOUBLE / (hi - lo)), 29) ELSE 0 END AS INTEGER) AS bin
      FROM latest, st),
c AS (SELECT bin, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin),
e AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30))
SELECT e.bin, lo + (hi - lo) / 30.0::DOUBLE * e.bin AS bin_start,
       lo + (hi - lo) / 30.0::DOUBLE * (e.bin + 1) AS bin_end, COALESCE(c.n, 0) AS title_count
FROM e CROSS JOIN st LEFT JOIN c ON c.bin = e.bin"""),
    "quartile_comparison": with_base(f"""o AS (SELECT sales, row_number() OVER (ORDER BY sales) - 1 AS rk FROM latest),
nn AS (SELECT count(*) AS n FROM latest),
q AS (SELECT {_quantile(0.25)} AS q25, {_quantile(0.75)} AS q75 FROM o, nn GROUP BY nn.n),
a AS (SELECT q25, q75,
        CAST(count_if(sales >= q75) AS BIGINT) AS nt, {msum('CASE WHEN sales >= q75 THEN sales END')} AS st,
        CAST(count_if(sales <= q25) AS BIGINT) AS nb, {msum('CASE WHEN sales <= q25 THEN sales END')} AS sb
      FROM latest, q GROUP BY q25, q75)
SELECT 'Top 25%' AS quartile, q75 AS threshold, nt AS title_count, st / nt AS avg_sales FROM a
UNION ALL SELECT 'Bottom 25%', q25, nb, sb / nb FROM a"""),
    "pubyear_performance": with_base(f"""x AS (SELECT 1) SELECT fiscal_year AS publication_year,
  {msum('sales')} AS total_sales_{L}, CAST(count(title_key) AS BIGINT) AS title_count
  FROM latest WHERE fiscal_year >= 2010 GROUP BY fiscal_year"""),
    "projections_linear": projected(PROJ.format(k=""), labels=LABELS[:1]),
    "projections_polynomial": projected(PROJ.format(k=""), labels=LABELS[1:2]),
    "projections_exponential": projected(PROJ.format(k=""), labels=LABELS[2:]),
    "projections_all": projected(PROJ.format(k="")),
    "projection_confidence": projected(PROJ.format(k="confidence, "), levels=tuple(CONF)),
    "projections_by_category": projected(PROJ.format(k="book_type, "), "book_type"),
    "projections_by_title": f"WITH RECURSIVE {BASE}, {title_points()}, {proj_sql('row_id, ')} {PROJ.format(k='row_id, ')}",
    "projection_summary": projected("SELECT year, " + ", ".join(
        f"COALESCE('$' || format('{{:,.0f}}', max(CASE WHEN method = '{x}' THEN value END)), 'N/A') "
        f"AS {x.lower().replace(' ', '_')}_sales" for x in LABELS) + f"""
  FROM proj WHERE metric = 'total_sales' AND year IN ({', '.join(str(L + o) for o in (3, 5) if o <= HORIZON)}) GROUP BY year"""),
    "projection_overlay": projected("""SELECT 'Historical Data' AS series, year, CAST(total_sales AS DOUBLE) AS value FROM series
  UNION ALL SELECT method || ' Projection', year, value FROM proj WHERE metric = 'total_sales'"""),
    # exports and their roles
    "parse_number": """SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 4
    WHEN 0 THEN CAST(l_extendedprice AS DOUBLE) WHEN 1 THEN trunc(CAST(l_quantity AS DOUBLE)) END AS number FROM lineitem""",
    "type_names": """SELECT list_aggregate(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])),
    'string_agg', ' ') AS type_name, CAST(count(*) AS BIGINT) AS title_count FROM part GROUP BY 1""",
    "latest_by_role": with_base("""x AS (SELECT 1) SELECT title_key, sales AS series_sales, 2 * sales AS latest_sales FROM latest"""),
    "validation_report": with_base("""x AS (SELECT 1)
SELECT 'required_columns' AS "check", 'error' AS severity, NULL::VARCHAR AS "column", NULL::BIGINT AS n_bad, NULL::BIGINT AS n_rows
UNION ALL SELECT 'quantity_columns', 'warn', NULL, NULL, NULL
UNION ALL SELECT 'numeric_content', CASE WHEN n_bad > 0 THEN 'warn' ELSE 'ok' END, 'Net Sales $ ' || year, n_bad, n_rows FROM (
  SELECT year, CAST(count_if((row_id + year) % 8 IN (5, 6)) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows
  FROM title_year GROUP BY year)"""),
    "dataset_sink": with_base("x AS (SELECT 1) SELECT row_id, title_key, book_type, fiscal_year, sales FROM latest"),
    "growth_text": with_base(f"""{yearly_cte()},
g AS (SELECT year, (total_sales / NULLIF(lag(total_sales) OVER (ORDER BY year), 0.0::DOUBLE) - 1.0::DOUBLE) * 100.0::DOUBLE AS x FROM series)
SELECT year, format('{{:+.1f}}%', round_even(x * 10.0::DOUBLE, 0) / 10.0::DOUBLE) AS growth_text FROM g"""),
}

ORACLE |= {
    "projection_sink": ORACLE["projections_all"],
    "projection_summary_sink": ORACLE["projection_summary"],
    "curate_observed": ORACLE["validate_numeric"].replace("n_bad, n_rows FROM (", "n_bad, n_rows, n_rows AS n_curated FROM (", 1),
    "ingest_multiline": with_base(f"""x AS (SELECT 1) SELECT d.title_key, concat('"', d.imprint, '",', chr(10), chr(10), 'House ', d.row_id % 10,
    CASE WHEN d.row_id % 7 = 0 THEN chr(10) ELSE '' END) AS imprint, ty.year,
    {_money_render("CAST((ty.row_id + ty.year) % 8 AS INTEGER)", "ty.net_sales", 4)} AS net_sales
  FROM title_year ty JOIN title_dim d ON d.row_id = ty.row_id"""),
    "malformed_records": with_base("""f AS (SELECT CASE WHEN row_id % 11 = 0 THEN 7 WHEN row_id % 13 = 0 THEN 8 ELSE 5 END AS n FROM title_dim)
SELECT CASE WHEN n = 5 THEN 'none' ELSE 'surplus_cells' END AS fault, CAST(n AS INTEGER) AS n_cells, count(*) AS n_records
FROM f GROUP BY n"""),
    "validation_failures": """SELECT 'bare' AS export, 'sales_columns' AS "check", 'error' AS severity, NULL::BIGINT AS n_bad, NULL::BIGINT AS n_rows
UNION ALL SELECT e, 'quantity_columns', 'warn', NULL, NULL FROM (VALUES ('bare'), ('empty')) t(e)
UNION ALL SELECT 'empty', 'empty', 'error', NULL, count(*) FROM part WHERE 1980 + p_size < 0
UNION ALL SELECT 'empty', 'numeric_content', 'ok', count(*), count(*) FROM part WHERE 1980 + p_size < 0""",
    "column_fill": with_base(f"""c AS (
  SELECT 0 AS position, 'WorkRef' AS "column", 'description' AS role, count(*) AS n_rows, count(work_ref) AS n_filled FROM title_dim
  UNION ALL SELECT 1, 'PubDate', 'description', count(*), count(pub_date) FROM title_dim
  UNION ALL SELECT 2, 'FiscalYearOfPublication', 'description', count(*), count(fiscal_year) FROM title_dim
  UNION ALL SELECT 3, 'Edition Status', 'description', count(*), count(edition_status) FROM title_dim
  UNION ALL SELECT 4, 'CoPub', 'description', count(*), count(copub) FROM title_dim
  UNION ALL SELECT 5 + year - {FIRST_YEAR}, 'Net Sales $ ' || year, 'sales ' || year, count(*), CAST(count_if(net_sales > 0) AS BIGINT)
    FROM title_year GROUP BY year)
SELECT CAST(position AS INTEGER) AS position, "column", role, n_rows, n_filled FROM c"""),
    "date_layouts": """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS month_first,
  strftime(l_shipdate, '%Y-%m-%d') AS day_first,
  CASE WHEN l_orderkey % 5 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d')
       WHEN day(l_shipdate) <= 12 THEN strftime(make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate)), '%Y-%m-%d') END AS mixed
  FROM lineitem""",
    "quantile_sketch": f"""SELECT CAST(p AS DOUBLE) AS p, (SELECT count(*) FROM lineitem) AS n, TRUE AS low_enough, TRUE AS high_enough
  FROM (VALUES {', '.join(f'({p})' for p in QUANTILES)}) t(p)""",
    "projections_monthly": f"""WITH RECURSIVE points AS (
  SELECT o_orderpriority, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS year, 'total_sales' AS metric,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
{proj_sql('o_orderpriority, ', mid=ORDER_ORIGIN, last=ORDER_LAST, horizon=12, grid=1.0)}
SELECT o_orderpriority, method, year AS period, value FROM proj""",
    "projections_daily": f"""WITH RECURSIVE points AS (
  SELECT CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS year, 'total_sales' AS metric,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
{proj_sql('', mid=_day(SHIP_ORIGIN), last=_day(SHIP_LAST), horizon=30, grid=1.0)}
SELECT method, year AS period, value FROM proj""",
}

for _name in ("loose_roles", "explicit_roles", "series_sink"):
    ORACLE[_name] = ORACLE["yearly_summary"]
ORACLE["yoy_growth_later_years"] = ORACLE["yoy_growth"] + " QUALIFY year > min(year) OVER ()"
