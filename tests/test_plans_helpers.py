import numpy as np
import pytest
from pyspark.sql import functions as F

from backlist.plans.ordinal import with_file_ordinal
from backlist.plans.quantiles import exact_quantiles
from tests.fixtures import write_rows


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.integers(0, 50, size=n).astype(float)            # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "sales double").repartition(5)
    got = exact_quantiles(df, "sales", [0.25, 0.5, 0.75], ["a", "b", "c"]).first()
    want = np.quantile(vals, [0.25, 0.5, 0.75])
    assert [got.a, got.b, got.c] == pytest.approx(list(want), rel=1e-12)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([], "sales double")
    assert exact_quantiles(df, "sales", [0.5]).first()[0] is None


def test_file_ordinal_multi_file(spark, tmp_path):
    d = tmp_path / "many"
    for f in range(4):
        write_rows(str(d / f"part-{f}.csv"), ["v"], [[f * 100 + i] for i in range(f + 2)])
    scan = spark.read.option("header", "true").option("multiLine", "true").csv(str(d))
    got = [(int(r.v), r.row_id) for r in with_file_ordinal(scan, "row_id").orderBy("row_id").collect()]
    want = [(f * 100 + i) for f in range(4) for i in range(f + 2)]
    assert [v for v, _ in got] == want and [o for _, o in got] == list(range(len(want)))


def test_file_ordinal_parquet(spark, tmp_path):
    p = str(tmp_path / "pq")
    spark.range(0, 50, 1, 3).write.parquet(p)
    scan = spark.read.parquet(p)
    rows = with_file_ordinal(scan, "o").collect()
    assert sorted(r.o for r in rows) == list(range(50))
