"""Differential check: the Spark parsers against pandas' own coercion on
seeded random money-like text."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from backlist.functions import parse_money, parse_quantity

ALPHABET = list("0123456789") * 4 + list(".,$()- +eEdfx_") + ["inf", "nan", "Infinity", "\t", "1e400"]


def samples(n=3000, seed=11):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.randint(0, 7)
        out.append("".join(rng.choice(ALPHABET) for _ in range(k)))
    return out


def pandas_money(values):
    s = pd.Series(values, dtype=object).astype(str)
    for a, b in (("$", ""), (",", ""), ("(", "-"), (")", ""), (" ", "")):
        s = s.str.replace(a, b, regex=False)
    return pd.to_numeric(s, errors="coerce").fillna(0).tolist()


def pandas_quantity(values):
    return pd.to_numeric(pd.Series(values, dtype=object), errors="coerce").fillna(0).tolist()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    # Spark parses decimal text correctly rounded; pandas' fast parser can be
    # one unit in the last place off for long exponents (e.g. "58E72")
    return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= 4e-16 * abs(b))


def _check(spark, fn, ref):
    vals = samples()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "t string")
           .select(fn(F.col("t"))).collect()]
    want = ref(vals)
    bad = [(v, g, w) for v, g, w in zip(vals, got, want) if not same(g, float(w))]
    assert not bad, bad[:10]


def test_money_matches_pandas(spark):
    _check(spark, parse_money, pandas_money)


def test_quantity_matches_pandas(spark):
    _check(spark, parse_quantity, pandas_quantity)
