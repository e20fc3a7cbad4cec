"""Special functions and the precipitation index against plain recomputations in Python."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import special
from panelkit.operators import spi


def series_p(a, x):
    """Regularised incomplete gamma function by the plain series, summed without loss by math.fsum."""
    if x <= 0 or x > a + 200 + 20 * math.sqrt(a):  # all of the mass lies below
        return 0.0 if x <= 0 else 1.0
    terms, term, n = [], 1 / a, 0
    while term > 1e-18 * (terms[0] if terms else 1) or n < x - a:
        terms.append(term)
        n += 1
        term *= x / (a + n)
    return min(1.0, math.exp(a * math.log(x) - x - math.lgamma(a)) * math.fsum(terms))


def digamma(x):
    out = 0.0
    while x < 30:
        out -= 1 / x
        x += 1
    r = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def best_shape(values):
    """The root of log k - digamma(k) = log(mean) - mean(log) by bisection."""
    s = math.log(np.mean(values)) - np.mean(np.log(values))
    low, high = 1e-6, 1e9
    for _ in range(300):
        k = math.sqrt(low * high)
        low, high = (k, high) if math.log(k) - digamma(k) > s else (low, k)
    return k


def scores(values, least=5):
    values = np.array([math.nan if v is None else v for v in values])
    positive = values[values > 0]
    if len(positive) < least:
        return [None] * len(values)
    k = best_shape(positive)
    theta, zeros = positive.mean() / k, (values == 0).sum() / len(values)
    p = [zeros if v <= 0 else zeros + (1 - zeros) * series_p(k, v / theta) for v in values]
    return [None if math.isnan(v) else NormalDist().inv_cdf(min(max(q, 1e-6), 1 - 1e-6)) for v, q in zip(values, p)]


def column(spark, f, rows, names):
    return [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).coalesce(1).select(f).collect()]


def test_special_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 123.4, 1e5]
    rows = [(x,) for x in xs]
    assert column(spark, special.log_gamma(F.col("x")), rows, "x") == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-13)
    assert column(spark, special.digamma(F.col("x")), rows, "x") == pytest.approx([digamma(x) for x in xs], rel=1e-12)
    h = 1e-4
    slopes = [(digamma(x + h * x) - digamma(x - h * x)) / (2 * h * x) for x in xs]
    assert column(spark, special.trigamma(F.col("x")), rows, "x") == pytest.approx(slopes, rel=1e-6)


def test_gamma_distribution_and_quantile(spark):
    rng = np.random.RandomState(0)
    pairs = [(float(a), float(a * f)) for a in [0.05, 0.4, 1, 2.5, 10, 80, 2000] for f in [0, 1e-3, 0.3, 0.9, 1.0, 1.1, 2, 5, 60]]
    assert column(spark, special.gamma_p(F.col("a"), F.col("x")), pairs, "ax") == pytest.approx([series_p(*p) for p in pairs], abs=1e-11)
    ps = [1e-6, 1e-4, 0.02, 0.074, 0.076, 0.3, 0.5, 0.7, 0.93, 1 - 1e-6, *rng.rand(50).tolist()]
    assert column(spark, special.normal_quantile(F.col("p")), [(p,) for p in ps], "p") == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-12)


def test_shape_of_greatest_likelihood(spark):
    rng = np.random.RandomState(1)
    samples = [rng.gamma(k, 40, 30) for k in (0.05, 0.3, 1, 2.3, 9, 200)] + [np.full(5, 3.0)]
    rows = [(float(math.log(x.mean()) - np.log(x).mean()),) for x in samples]
    got = column(spark, special.gamma_shape(F.col("s")), rows, "s")
    assert got[:-1] == pytest.approx([best_shape(x) for x in samples[:-1]], rel=1e-9) and got[-1] == 1e6


def test_spi_equals_plain_recomputation(spark):
    rng = np.random.RandomState(2)
    rows, want = [], {}
    for e in range(4):
        rain = [[float(x) for x in np.where(rng.rand(20) < 0.2 * e, 0, rng.gamma(0.4 + e, 30, 20))] for _ in range(12)]
        for y in range(20):
            for m in range(12):
                v = None if rng.rand() < 0.05 else rain[m][y] if e < 3 or m % 2 else 0.0
                rows.append((e, 2000 + y, m + 1, v))
    got = {(r.e, r.year, r.month): r for r in spi.spi(spark.createDataFrame(rows, "e int, year int, month int, rain double"), "e", "rain").collect()}
    value = {r[:3]: r[3] for r in rows}
    for e in range(4):
        line = [value[e, 2000 + t // 12, t % 12 + 1] for t in range(240)]
        for scale in (1, 3):
            rolled = [None if t < scale - 1 or None in line[t - scale + 1 : t + 1] else sum(line[t - scale + 1 : t + 1]) for t in range(240)]
            for m in range(12):
                want = scores(rolled[m::12])
                have = [got[e, 2000 + y, m + 1][f"SPI{scale}"] for y in range(20)]
                assert [h is None for h in have] == [w is None for w in want]
                assert [h for h in have if h is not None] == pytest.approx([w for w in want if w is not None], abs=1e-8)


def test_spi_without_rows_or_fit(spark):
    schema = "e string, year int, month int, rain double"
    assert spi.spi(spark.createDataFrame([], schema), "e", "rain").count() == 0
    rows = [("a", 2000 + y, 1, v) for y, v in enumerate([1.0, 2.0, 0.0, None, float("nan"), 4.0, 5.0])] + [(None, 2000, 1, 3.0)]
    assert all(r.SPI1 is None for r in spi.spi(spark.createDataFrame(rows, schema), "e", "rain").collect())
    plan = spi.spi(spark.createDataFrame(rows, schema), "e", "rain")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
