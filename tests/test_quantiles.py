import math
import random

import pytest

from opinionlake.operators.quantiles import exact_quantile

SCHEMA = "g string, x double, _other string"


def plain(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a + (b - a) * (at - math.floor(at))


def rows():
    rng = random.Random(5)
    out = [("wide", rng.gauss(0, 1e6)) for _ in range(4000)]
    out += [("tied", 7.0)] * 1500 + [("tied", rng.random() * 14) for _ in range(1500)]
    out += [("two", float(i % 2)) for i in range(2001)] + [("one", 3.5), (None, -1.0), (None, 2.0)]
    out += [("wide", None), ("empty", None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("p, limit", [(0.0, 20), (0.5, 20), (0.99, 20), (1.0, 1), (0.5, 10_000)])
def test_equals_a_sort(spark, p, limit):
    given = rows()
    df = spark.createDataFrame([(g, x, "o") for g, x in given], SCHEMA).repartition(4)
    got = {r.g: r.bound for r in exact_quantile(df, "x", p, ["g"], limit).collect()}
    groups = {g for g, x in given if x is not None}
    assert set(got) == groups
    for g in groups:
        assert got[g] == pytest.approx(plain([x for h, x in given if h == g and x is not None], p), abs=1e-9)


def test_no_rows_and_nan(spark):
    assert exact_quantile(spark.createDataFrame([], SCHEMA), "x", 0.5, ["g"]).collect() == []
    df = spark.createDataFrame([("a", float("nan"), ""), ("a", 1.0, ""), ("a", 2.0, "")], SCHEMA)
    assert exact_quantile(df, "x", 0.5, ["g"]).first().bound == 2.0
    assert math.isnan(exact_quantile(df, "x", 1.0, ["g"]).first().bound)
