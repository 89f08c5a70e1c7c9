"""Exact quantiles by narrowing, against sorting."""

import math
import random

import numpy as np
import pytest

from evalframe.operators import quality, quantiles


def values(kind, draw):
    match kind:
        case "uniform":
            return [draw.random() for _ in range(4000)]
        case "ties":
            return [0.0] * 1600 + [1.0] * 800 + [draw.random() for _ in range(1600)]
        case "decades":
            return [10.0 ** draw.uniform(-300, 300) * draw.choice([-1, 1]) for _ in range(4000)]
        case "one":
            return [7.0] * 3000
        case "ends":
            return [-math.inf] * 900 + [math.inf] * 900 + [float(k) for k in range(300)]


@pytest.mark.parametrize("kind", ["uniform", "ties", "decades", "one", "ends"])
def test_quantiles(spark, kind):
    data = values(kind, random.Random(kind))
    probabilities = [0.0, 0.25, 0.4, 0.5, 0.75, 0.999, 1.0]
    rows = [("g", x) for x in data] + [(None, 5.0), (None, 6.0), ("h", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(r["g"], r["p"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["g"], "x", probabilities, ordered_rows=50).collect()}
    assert set(got) == {(g, p) for g in ("g", None) for p in probabilities}
    ordered = sorted(data)
    for p in probabilities:
        at = p * (len(data) - 1)
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = a if at == math.floor(at) or a == b else a + (at - math.floor(at)) * (b - a)
        assert got[("g", p)] == want or math.isclose(got[("g", p)], want, rel_tol=1e-12) or (math.isnan(want) and math.isnan(got[("g", p)]))
    assert got[(None, 0.5)] == 5.5 and got[(None, 0.25)] == 5.25


def test_large_group_is_not_ordered(spark):
    """100,000 distinct values, 200 of which are ordered at a time."""
    df = spark.range(100_001).selectExpr("1 as g", "cast(pmod(id * 7919, 100001) as double) as x")
    got = [r["quantile"] for r in quantiles.exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.75], ordered_rows=200).orderBy("p").collect()]
    assert got == [25_000.0, 50_000.0, 75_000.0]


def test_describe_columns(spark):
    draw = random.Random(3)
    rows = [("a", draw.random(), draw.randrange(5)) for _ in range(500)] + [("b", None, 3), ("c", 0.5, None)]
    df = spark.createDataFrame(rows, "g string, x double, k int")
    table = {(r["g"], r["column"]): r for r in quality.describe_columns(df, ["g"], ["x", "k"]).collect()}
    assert set(table) == {("a", "x"), ("a", "k"), ("b", "k"), ("c", "x")}
    x = np.array([r[1] for r in rows[:500]])
    got = table[("a", "x")]
    assert np.allclose([got[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")],
                       [500, x.mean(), x.std(ddof=1), x.min(), *np.percentile(x, [25, 50, 75]), x.max()])
    assert table[("c", "x")]["std"] is None and table[("c", "x")]["q50"] == 0.5
    assert quality.describe_columns(df.where("false"), ["g"], ["x"]).count() == 0
