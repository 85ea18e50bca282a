"""Multi-line exports read by many tasks, malformed records, one-pass curation."""

import random

import pytest
from pyspark.sql import functions as F

from backlist.sources import csv_catalog as csvc
from backlist.sources import records as rec

HEADER = ["WorkRef", "PubDate", "FiscalYearOfPublication", '" Net Sales $ \n2023 "', '" Net Sales $ \n2024 "']


def cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def export(n: int, seed: int) -> str:
    """Line breaks, empty lines, commas and doubled quotes inside quotes, and
    empty lines between records."""
    rng = random.Random(seed)
    odd = ["a\nb", "x,y", 'say "so"', "\n\n", "", '"', "\n", "tail,\n", "plain", ' "lead', "N/A"]
    out = [",".join(cell(h) for h in HEADER)]
    for k in range(n):
        out.append(",".join(cell(x) for x in (f"w{k}" + rng.choice(odd).replace("N/A", ""), "2020-01-05", "2020",
                                               rng.choice(["1,200", "(5)", "7"]), rng.choice(["", "3", *odd]))))
        if rng.random() < 0.05:
            out.append("")
    return "\n".join(out) + "\n"


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(raw):
    return raw.df.orderBy("row_id").collect()


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_split_files_read_as_whole_ones(spark, tmp_path, small_splits, eol):
    for k in (2, 10):
        (tmp_path / f"part-{k}.csv").write_text(export(150, k).replace("\n", eol), newline="")
    one = rows(csvc.read_catalog(spark, str(tmp_path), years=(2023, 2024)))
    raw = csvc.read_catalog(spark, str(tmp_path), years=(2023, 2024), splittable=True)
    assert rec.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert len(one) == 300 and rows(raw) == one
    assert [r.title_key for r in csvc.curate(raw).titles.orderBy("row_id").collect()] == \
        [f"{r._c0 or 'nan'}_{r.row_id}" for r in one]


def test_records_end_with_cr_lf_and_cells_break_with_lf(spark, tmp_path):
    """As spreadsheets write them."""
    p = tmp_path / "x.csv"
    p.write_text(",".join(cell(h) for h in HEADER) + '\r\n"w\n1",2020-01-01,2020,1,2\r\n\r\nw2,2020-01-01,2020,1,3\r\n', newline="")
    raw = csvc.read_catalog(spark, str(p), years=(2023, 2024), splittable=True)
    assert [(r.title_key, r.sales_2024) for r in csvc.curate(raw).titles.orderBy("row_id").collect()] == [("w\n1_0", 2.0), ("w2_1", 3.0)]


def test_a_record_over_several_splits(spark, tmp_path, small_splits):
    long = "\n".join(["line, of a cell"] * 200)  # some four splits
    p = tmp_path / "long.csv"
    p.write_text("a,b\n1," + cell(long) + "\n2,x\n3," + cell(long) + "\n")
    got = [(r.rec, r.text, r.quotes) for r in rec.read_records(spark, str(p)).orderBy("start", "rec").collect()]
    assert [t for _, t, _ in got] == ["a,b", "1," + cell(long), "2,x", "3," + cell(long)]
    assert [q for _, _, q in got] == [0, 2, 0, 2]


def test_a_misplaced_quote_is_not_gathered(spark, tmp_path, small_splits):
    p = tmp_path / "bad.csv"
    p.write_text('a,b\n1,"x\n' + "2,y\n" * 6000 + '3,"z\n')
    with pytest.raises(Exception, match="bad.csv has a record over more than"):
        rec.read_records(spark, str(p)).collect()


BAD = ('w1,2020-01-01,2020,1,2\n'
       'w2,2020-01-01,2020,1,2,,99\n'          # a surplus cell behind an empty one
       'w3,2020-01-01,2020\n'                  # short: the rest is missing
       'w4,2020-01-01,2020,1,2,"a,b",,x\n'     # three surplus cells
       'w5,2020-01-01,2020,"1,000",2\n')


@pytest.mark.parametrize("splittable", [False, True])
def test_malformed_records_are_listed_and_counted(spark, tmp_path, splittable):
    p = tmp_path / "m.csv"
    p.write_text(",".join(cell(h) for h in HEADER) + "\n" + BAD)
    raw = csvc.read_catalog(spark, str(p), years=(2023, 2024), splittable=splittable)
    assert [tuple(r) for r in csvc.malformed(raw).orderBy("row_id").collect()] == [
        (1, "surplus_cells", 7, "w2,2020-01-01,2020,1,2,,99"), (3, "surplus_cells", 8, 'w4,2020-01-01,2020,1,2,"a,b",,x')]
    ok, report = csvc.validate(raw)
    assert ok and csvc.data_errors(report) == ["2 of 5 rows have cells beyond the header"]
    with pytest.raises(Exception, match="malformed record .surplus_cells. in row"):
        csvc.curate(raw).titles.collect()
    kept = csvc.curate(raw, malformed="drop").titles.orderBy("row_id").collect()
    assert [(r.title_key, r.sales_2023) for r in kept] == [("w1_0", 1.0), ("w3_2", 0.0), ("w5_4", 1000.0)]
    with pytest.raises(ValueError):
        csvc.curate(raw, malformed="ignore")


def test_unclosed_quotes(spark, tmp_path):
    p = tmp_path / "open.csv"
    p.write_text(",".join(cell(h) for h in HEADER) + '\nw1,2020-01-01,2020,1,2\nw2,2020-01-01,2020,1,"2\nw3,2020-01-01,2020,1,2\n')
    raw = csvc.read_catalog(spark, str(p), years=(2023, 2024), splittable=True)
    assert [(r.row_id, r.fault) for r in csvc.malformed(raw).collect()] == [(1, "unclosed_quote")]
    assert "unclosed_quote" in {r["check"] for r in csvc.validate(raw)[1].collect()}
    whole = csvc.read_catalog(spark, str(p), years=(2023, 2024))
    warned = csvc.validate(whole)[1].where("check = 'odd_quotes'").collect()
    assert [(r.severity, r.n_bad, r.n_rows) for r in warned] == [("warn", 1, 1)]


def test_quotes_inside_cells(spark, tmp_path):
    """Harmless within a line; over lines, a fault of the splittable reader."""
    p = tmp_path / "stray.csv"
    p.write_text(",".join(cell(h) for h in HEADER) + '\nw1,2020-01-01,2020,1,2 "x"\nw"2,2020-01-01,2020,1,2\nw3",2020-01-01,2020,1,2\n')
    raw = csvc.read_catalog(spark, str(p), years=(2023, 2024), splittable=True)
    assert [(r.row_id, r.fault) for r in csvc.malformed(raw).collect()] == [(1, "stray_quote")]
    assert csvc.malformed(csvc.read_catalog(spark, str(p), years=(2023, 2024))).count() == 0


@pytest.mark.parametrize("splittable", [False, True])
def test_curation_and_validation_in_one_pass(spark, tmp_path, splittable):
    p = tmp_path / "m.csv"
    p.write_text(export(400, 7) + BAD.replace(",1,2", ",abc,2", 1))
    raw = csvc.read_catalog(spark, str(p), years=(2023, 2024), splittable=splittable)
    want = sorted(map(str, csvc.validate(raw)[1].collect()))
    ok, report, none = csvc.curate_to(raw, str(tmp_path / "refused"))
    assert not ok and none is None and sorted(map(str, report.collect())) == want
    ok, report, cat = csvc.curate_to(raw, str(tmp_path / "titles"), malformed="drop")
    assert ok and sorted(map(str, report.collect())) == want
    assert cat.titles.count() == raw.df.count() - 2
    assert cat.titles.orderBy("row_id").collect() == csvc.curate(raw, malformed="drop").titles.orderBy("row_id").collect()


def test_one_pass_over_an_empty_or_headless_export(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text(",".join(cell(h) for h in HEADER) + "\n")
    for splittable in (False, True):
        ok, report, cat = csvc.curate_to(csvc.read_catalog(spark, str(p), years=(2023, 2024), splittable=splittable), str(tmp_path / "t"))
        assert not ok and cat is None and "empty" in {r["check"] for r in report.collect()}
    p.write_text("WorkRef,x\n1,2\n")
    ok, report, cat = csvc.curate_to(csvc.read_catalog(spark, str(p)), str(tmp_path / "never"))
    assert not ok and cat is None and not (tmp_path / "never").exists()
    assert {"required_columns", "sales_columns"} <= {r["check"] for r in report.collect()}


def test_cell_count(spark):
    texts = {"a,b": 2, '"a,b",c': 2, "": 1, ",,": 3, '"x""y,z",,': 3, 'a,"open, b': 2}
    df = spark.createDataFrame(list(texts.items()), "t string, n int")
    assert df.where(csvc.cell_count(F.col("t")) != F.col("n")).count() == 0
