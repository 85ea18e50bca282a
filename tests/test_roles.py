from backlist.sources.roles import dedup_names, detect_roles


def test_dedup_like_pandas():
    assert dedup_names(["a", "a", "a.1", "a", None, "Net", "net"]) == \
        ["a", "a.1", "a.1.1", "a.2", "Unnamed: 4", "Net", "net"]


def test_strict_roles_and_latest_rules():
    cols = ["WorkRef", '" Net Sales $ \n2022 "', "Net Sales $ 2024", "Net Sales $ 2024 Adj",
            "Net Sales Q 2024", "net sales $ 2023", "Net Sales $ 2015"]
    r = detect_roles(cols)
    assert r.sales == ('" Net Sales $ \n2022 "', "Net Sales $ 2024", "Net Sales $ 2024 Adj")
    assert r.quantity == ("Net Sales Q 2024",)
    # yearly series: first column in file order; latest views: largest name
    assert r.sales_by_year[2024] == "Net Sales $ 2024"
    assert r.latest_sales() == (2024, "Net Sales $ 2024 Adj")
    assert any("2024" in w for w in r.warnings)
    assert r.series_years == [2022, 2024]


def test_loose_and_explicit_roles():
    cols = ["Revenue 2020", "Units 2020", "Net Sales Q 2020", "Title"]
    r = detect_roles(cols, mode="loose")
    assert "Revenue 2020" in r.sales and "Units 2020" in r.quantity
    assert "Net Sales Q 2020" in r.sales and "Net Sales Q 2020" in r.quantity
    assert r.warnings
    e = detect_roles(cols, sales=["Revenue 2020", "Missing"], quantity=["Units 2020"])
    assert e.sales == ("Revenue 2020",) and e.quantity == ("Units 2020",)
    assert any("Missing" in w for w in e.warnings)


def test_describe_roles(spark):
    from backlist.sources.roles import describe_roles
    r = detect_roles(["WorkRef", "Net Sales $ 2023", "Net Sales $ 2024", "Net Sales Q 2024"])
    row = describe_roles(spark, r).first()
    assert (row.sales_columns, row.quantity_columns, row.total_columns) == (2, 1, 4)
    assert row.series_years == [2023, 2024] and row.latest_sales_column == "Net Sales $ 2024"
