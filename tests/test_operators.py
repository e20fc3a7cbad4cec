"""Panel operators on small frames with values computed by hand or in plain Python."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit import queries, resolve
from panelkit.functions import dates, numbers, stats
from panelkit.functions.rates import INFLATION
from panelkit.operators import audit, breaks, dedupe, gaps, geo, lookup, quantiles, series, spi, validate
from panelkit.plans import apy, cluster, price, weather


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def plain_fill(panel, first, last):
    """The gap rules one month after another: {(y, m): value or None} -> the same, filled."""
    v = {(y, m): panel.get((y, m)) for y in range(first, last + 1) for m in range(1, 13)}
    gone = [y for y in range(first, last + 1) if all(v[y, m] is None for m in range(1, 13))]
    for y, m in itertools.product(gone, range(1, 13)):
        near = [x for x in (v.get((y - 1, m)), v.get((y + 1, m)) if y + 1 not in gone else None) if x is not None]
        v[y, m] = sum(near) / len(near) if near else None
    keys = sorted(v)
    known = [i for i, k in enumerate(keys) if v[k] is not None]
    return {k: None if not known else float(np.interp(i, known, [v[keys[j]] for j in known])) for i, k in enumerate(keys)}


def test_fill_months_follows_the_rules(spark):
    rnd = np.random.RandomState(1)
    panels = {e: {(y, m): float(rnd.randint(1, 100)) for y in range(2006, 2013) for m in range(1, 13) if rnd.rand() > 0.2 and not (e * y) % 3 == 1} for e in range(12)}
    panels[3] = {(2009, 5): 7.0}
    rows = [(e, y, m, x, x - 1, 2) for e, p in panels.items() for (y, m), x in p.items()] + [(99, 2008, 1, None, None, 1)]
    df = spark.createDataFrame(rows, "e int, year int, month int, modal double, low double, days int")
    got = {(r.e, r.year, r.month): r for r in gaps.fill_months(df, "e", 2006, 2012, ("modal", "low"), "modal", "days").collect()}
    assert len(got) == 13 * 84
    for e, p in panels.items():
        for (y, m), x in plain_fill(p, 2006, 2012).items():
            r = got[e, y, m]
            assert math.isclose(r.modal, x) and math.isclose(r.low, x - 1) and r.is_imputed == ((y, m) not in p) and r.days == (2 if (y, m) in p else 0)
    assert all(r.modal is None and r.is_imputed == 1 for (e, _, _), r in got.items() if e == 99)
    again = gaps.fill_months(df, "e", 2006, 2012, ("modal", "low"), "modal", "days").drop("is_imputed")
    twice = gaps.fill_months(again, "e", 2006, 2012, ("modal", "low"), "modal").where("modal is not null")
    assert {(r.e, r.year, r.month): r.modal for r in twice.collect()} == {k: r.modal for k, r in got.items() if r.modal is not None}


def test_fill_years(spark):
    rows = [("d", dt.date(2008, 2, 29), 2008, 100.0), ("d", dt.date(2008, 3, 1), 2008, 100.0), ("d", dt.date(2011, 1, 5), 2011, 50.0)]
    df = spark.createDataFrame(rows, "e string, date date, year int, p double")
    got = {(r.year, r.date): r for r in gaps.fill_years(df, "e", "date", ("p",), INFLATION, 2007, 2012).collect()}
    assert set(got) == {(y, dt.date(y, 3, 1)) for y in (2007, 2009, 2010)} | {(2012, dt.date(2012, 1, 5))}
    assert got[2009, dt.date(2009, 3, 1)].p == round(100 * 1.038, 2) and got[2010, dt.date(2010, 3, 1)].p == round(round(100 * 1.038, 2) * 1.096, 2)
    assert got[2007, dt.date(2007, 3, 1)].p == round(100 / 1.081, 2) and got[2007, dt.date(2007, 3, 1)].imputed_from_year == 2008
    assert got[2010, dt.date(2010, 3, 1)].imputed_from_year == 2009
    log = {r.year_filled: (r.source_year, r.direction, r.rows_written, r.rows_dropped_feb29) for r in gaps.fill_log(df, "e", "date", 2007, 2012).collect()}
    assert log == {2007: (2008, "backward", 1, 1), 2009: (2008, "forward", 1, 1), 2010: (2009, "forward", 1, 0), 2012: (2011, "forward", 1, 0)}


def test_series(spark):
    x = [1.0, 3.0, 3.0, 2.0, None, 5.0, 6.0, 7.0, 1.0]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(x)], "e string, t int, x double").repartition(3)
    w = series.by_time("e", "t")
    s = df.withColumns({"n": F.row_number().over(w), "d": series.difference(F.col("x"), w), "r": series.change(F.col("x"), w), "sd": series.rolling(F.col("x"), w, 3, F.stddev_samp), "fall": series.drawdown(F.col("x"), w), "med": series.rolling_median(F.abs("x"), w, 3, 2)})
    s = s.withColumns({"up": series.streak(F.col("x") > 1, w, F.col("n")), "turn": series.turning(F.col("d"), w)})
    rows = s.orderBy("t").collect()
    assert [r.d for r in rows] == [None, 2.0, 0.0, -1.0, None, None, 1.0, 1.0, -6.0]
    assert [r.up for r in rows] == [0, 1, 2, 3, 0, 1, 2, 3, 0] and sum(r.turn for r in rows) == 3
    assert rows[2].sd == pytest.approx(np.std([1, 3, 3], ddof=1)) and rows[4].sd is None and rows[5].sd is None
    assert rows[3].fall == pytest.approx(-1 / 3) and rows[1].r == 2 and rows[1].med == 2
    assert s.agg(series.mean_run(F.col("x") > 1, F.col("up")).alias("m")).first().m == 3


def tau_b(x):
    s = sum(np.sign(b - a) for a, b in itertools.combinations(x, 2))
    n0, ties = len(x) * (len(x) - 1) / 2, sum(k * (k - 1) / 2 for k in (x.count(v) for v in set(x)))
    return s / math.sqrt(n0 * (n0 - ties)) if n0 > ties else None


def test_statistics(spark):
    rnd = np.random.RandomState(4)
    groups = {g: [float(v) for v in rnd.randint(0, 6, n)] for g, n in enumerate((1, 2, 3, 4, 5, 30))} | {90: [2.0, 2.0, 2.0]}
    df = spark.createDataFrame([(g, t, x) for g, v in groups.items() for t, x in enumerate(v)], "g int, t int, x double")
    x, t = F.col("x"), F.col("t")
    got = df.groupBy("g").agg(stats.cv(x).alias("cv"), stats.iqr(x).alias("iqr"), stats.slope(x, t, 3).alias("slope"), stats.end_growth(t, x).alias("growth"), stats.ordered(t, x).alias("o"))
    for r in got.withColumns({"tau": stats.kendall_tau(F.col("o")), "z": stats.kendall_z(F.col("o"))}).collect():
        v = groups[r.g]
        assert r.o == v and r.iqr == pytest.approx(np.percentile(v, 75) - np.percentile(v, 25))
        assert (r.slope is None) if len(v) < 3 else r.slope == pytest.approx(np.polyfit(range(len(v)), v, 1)[0], abs=1e-12)
        assert r.tau == pytest.approx(tau_b(v)) if len(v) > 1 and tau_b(v) is not None else r.tau is None
        if len(v) > 1 and np.mean(v):
            assert r.cv == pytest.approx(np.std(v, ddof=1) / np.mean(v))
        if len(v) >= 4 and sum(v[:2]) > 0:
            assert r.growth == pytest.approx((sum(v[-2:]) / sum(v[:2])) ** (1 / (len(v) - 2)) - 1)
    p = one(spark, *[stats.two_sided_p(F.lit(z)).alias(f"p{i}") for i, z in enumerate((0.0, 1.0, 1.96, -3.0))])
    assert list(p) == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in (0, 1, 1.96, 3)], abs=3e-7)


def test_quadratic_and_concentration(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([(float(i - 3), v) for i, v in enumerate(y)], "u double, y double")
    r = df.agg(stats.quadratic(F.col("y"), F.col("u")).alias("q"), stats.concentration(F.col("y")).alias("c")).first()
    assert r.q == pytest.approx(np.polyfit(range(7), y, 2)[0]) and r.c == pytest.approx(12 * sum(v * v for v in y) / sum(y) ** 2)


def test_dates_and_numbers(spark):
    texts = ["2015-03-04", "2015-03-04T10:00:00Z", "04/03/2015", "04-03-2015", "20150304", "31/02/2015", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.parse_date(F.col("t")).alias("d"), dates.date_format(F.col("t")).alias("f")).collect()
    assert [r.d for r in got] == [dt.date(2015, 3, 4)] * 5 + [None] * 3
    assert [r.f for r in got] == ["yyyy-MM-dd", None, "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd", None, None, None]
    r = one(spark, dates.year_in_name(F.lit("a_2007_1999.csv")).alias("a"), dates.year_in_name(F.lit("a_123.csv")).alias("b"), dates.crop_year(F.lit("1998-99")).alias("c"), dates.crop_year(F.lit("2008-09")).alias("d"), dates.in_year(F.lit(dt.date(2008, 2, 29)), F.lit(2009)).alias("e"), numbers.to_number(F.lit(" 1,234.5 ")).alias("f"), numbers.to_number(F.lit("NaN")).alias("g"), numbers.midpoint(F.lit(1.0), F.lit(4.0)).alias("h"), numbers.midpoint(F.lit(2.0), F.lit(5.0)).alias("i"), numbers.carry_factor(F.lit(2010), F.lit(2012), INFLATION).alias("j"), numbers.carry_factor(F.lit(2012), F.lit(2010), INFLATION).alias("k"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (2007, None, 1999, 2009, None, 1234.5, None, 2.0, 4.0)
    assert r.j == pytest.approx(1.089 * 1.074) and r.k == pytest.approx(1 / (1.089 * 1.074))
    rows = spark.createDataFrame([("a", "03/04/2015"), ("a", "2015-04-03"), ("b", "2015-04-03"), ("b", "2015-04-04"), ("b", "05/04/2015")], "f string, t string")
    assert sorted(str(r.d) for r in dates.parse_by_majority(rows, "f", "t", "d").collect()) == ["2015-04-03", "2015-04-03", "2015-04-03", "2015-04-04", "None"]


def test_dedupe(spark):
    rows = [("a", 1, 1.0, 2.0, 3.0), ("b", 1, 1.0, 2.0, 3.0), ("b", 2, 1.0, 2.0, 3.0), ("c", 1, 1.0, None, 3.0), ("c", 2, 1.0, 2.0, 3.0), ("d", 1, 10.0, 2.0, 13.0), ("d", 2, 12.0, 2.0, 15.0), (None, 1, 5.0, None, 6.0), (None, 2, 5.0, 5.5, 6.0)]
    df = spark.createDataFrame(rows, "k string, pos int, low double, modal double, high double")
    assert {r.k: r.type for r in dedupe.classify(df.drop("pos"), ["k"], ["low", "modal", "high"]).collect()} == {"b": "exact", "c": "missing value", "d": "price conflict", None: "missing value"}
    got = {r.k: (r.how, r.low, r.modal, r.high) for r in dedupe.resolve(df, ["k"], "pos", "low", "high", "modal").collect()}
    assert got == {"a": ("single", 1, 2, 3), "b": ("exact", 1, 2, 3), "c": ("fullest", 1, 2, 3), "d": ("merged", 10, 12, 15), None: ("fullest", 5, 5.5, 6)}


def test_audit(spark):
    good = [("d", "2010.csv", "1", f"2010-01-{i:02d}", "10", "20", "15") for i in range(1, 15)]
    bad = [("d", "2011.csv", "1", "01/02/2010", "n/a", "5", "50"), ("d", "2011.csv", "1", "2010-02-03", "-1", "0", "x"), ("d", "2011.csv", "1", "2010-02-03", "9", "5", "7"), ("d", "2011.csv", "1", "nonsense", None, None, None)]
    df = spark.createDataFrame(good + bad, "district string, filename string, market_id string, date string, min_price string, max_price string, modal_price string")
    got = {r.filename: r for r in audit.audit(df).collect()}
    assert got["2010.csv"].total_issues == 0
    b = got["2011.csv"]
    assert b.F4_year_mismatch and b.D2_invalid_dates and b.n_invalid_dates == 1 and b.D4_mixed_date_formats and b.n_duplicate_dates == 2
    assert b.P1_non_numeric_prices and b.P2_negative_prices and b.P3_zero_prices and b.n_price_inversions == 1 and b.n_modal_violations == 2
    assert b.critical_issues == 7 and b.warning_issues == 2
    assert {r.flag: r.files for r in audit.summary(audit.audit(df)).collect()}["P1_non_numeric_prices"] == 1
    flags = audit.header_flags(["Price Date", "market_id", "min_price", "Modal_x0020_Price", "Extra"])
    assert flags["missing_cols"] == "max_price" and flags["extra_cols"] == "Extra" and flags["nonstandard_cols"] == "Price Date|Modal_x0020_Price"
    jump = [("e", i, float(v)) for i, v in enumerate([1, 2, 1, 2, 1, 2, 50, 2])]
    assert audit.jumps(spark.createDataFrame(jump, "k string, t int, v double"), ["k"], ["t"], "v").first().n_jumps == 2
    out = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double")
    assert audit.outlier_bounds(out, ["k"], "v").first().n_outliers == 1


def test_resolvers():
    columns = ["Price Date", "Modal_x0020_Price", "Max Price (Rs.)"]
    assert resolve.find_column(columns, ("date",)) == "Price Date" and resolve.find_column(columns, ("modal price",)) == "Modal_x0020_Price" and resolve.find_column(columns, ("max price",)) == "Max Price (Rs.)"
    assert resolve.find_column(columns, ("arrivals",)) is None and resolve.detect_column(["DistrictName", "StateName"], ("state", "district")) == "StateName"
    with pytest.raises(ValueError):
        resolve.require(["a"], ("a", "b"))


def test_content_resolvers(spark):
    df = spark.createDataFrame([("x", "Uttar Pradesh", "Agra"), ("x", "Bihar", "Patna")], "a string, s string, d string")
    assert resolve.column_by_content(df, "uttar") == "s" and resolve.identifier_column(df.select("a", "d")) == "d" and resolve.column_by_content(df, "nowhere") is None


def test_geography(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    bent = [(1.0, 1.0), (5.0, 1.0), (5.0, 5.0), (3.0, 2.0)]
    polys = spark.createDataFrame([("square", [{"lon": x, "lat": y} for x, y in square]), ("bent", [{"lon": x, "lat": y} for x, y in bent])], "name string, ring array<struct<lon: double, lat: double>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.2), (3, 9.0, 9.0), (4, 2.5, 4.0)], "id int, lon double, lat double")
    got = {(r.id, r.name) for r in geo.contained(pts, polys).collect()}
    assert got == {(1, "square"), (2, "square"), (2, "bent"), (3, None), (4, None)}
    c = {r.name: r.c for r in polys.select("name", geo.centroid(F.col("ring")).alias("c")).collect()}
    assert (c["square"].lon, c["square"].lat) == (1.0, 1.0)
    cells = geo.grid(spark.range(1), 0.0, 0.0, 3, 4)
    near = {r.id: (r.lat_idx, r.lon_idx) for r in geo.nearest_cell(pts, cells, 0.0, 0.0, 3, 4).collect()}
    assert cells.count() == 12 and near == {1: (0, 0), 2: (1, 1), 3: (2, 3), 4: (2, 2)}
    raster = spark.createDataFrame([(2000, 1, 0, 0, 1.0), (2000, 1, 0, 1, 3.0), (2000, 1, 1, 1, None)], "year int, day int, lat_idx int, lon_idx int, v double")
    owner = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 1, "b")], "lat_idx int, lon_idx int, e string")
    assert {r.e: r.v for r in geo.over_cells(raster, owner, "e", "v").collect()} == {"a": 2.0, "b": None}


def test_lookup(spark):
    key = "u int, p int"
    req = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], key)
    left = lookup.outstanding(req, spark.createDataFrame([(1, 1)], key), spark.createDataFrame([(2, 1), (2, 2)], key), ["u"], "p")
    assert sorted(tuple(r) for r in left.collect()) == [(1, 2), (3, 1)]


def matrix_change_points(x, penalty=3.0, least=2):
    """The same search with the whole kernel matrix and every start."""
    n = len(x)
    if n < 4:
        return []
    d2 = (x[:, None] - x[None]) ** 2
    middle = np.median(d2[np.triu_indices(n, 1)])
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = np.exp(-np.clip(d2 / middle if middle > 0 else d2, 1e-2, 1e2)).cumsum(axis=0).cumsum(axis=1)
    best, back = {0: -penalty}, {0: 0}
    for end in range(least, n + 1):
        values = {s: best[s] + (end - s) - (total[end, end] - total[s, end] - total[end, s] + total[s, s]) / (end - s) + penalty for s in best if end - s >= least}
        back[end] = min(values, key=values.get)
        best[end] = values[back[end]]
    out, end = [], n
    while back[end] > 0:
        end = back[end]
        out.append(end)
    return out[::-1]


def test_breaks_equal_the_search_with_a_matrix():
    rnd = np.random.RandomState(5)
    for n in (4, 5, 17, 60, 150):
        for levels in (1, 3, 6):
            x = np.repeat(rnd.normal(0, 3, levels), -(-n // levels))[:n] + rnd.normal(0, 0.5, n)
            assert breaks.change_points(x) == matrix_change_points(x)
    assert breaks.change_points(np.zeros(50)) == matrix_change_points(np.zeros(50)) == []


def test_pair_distances():
    rnd = np.random.RandomState(6)
    for x in (rnd.normal(size=40), rnd.randint(0, 5, 31).astype(float), np.zeros(6)):
        every = np.sort(np.abs(x[:, None] - x[None])[np.triu_indices(len(x), 1)])
        for rank in (1, 7, len(every) // 2, len(every)):
            assert breaks.pair_distance(x, rank) == pytest.approx(every[rank - 1], abs=1e-12)


def test_breaks_of_a_long_series():
    """100,000 values with a break every 1,000: a kernel matrix of them would take 80 GB."""
    rnd = np.random.RandomState(7)
    x = np.repeat(np.tile([0.0, 4.0], 50), 1000) + rnd.normal(0, 0.3, 100_000)
    assert breaks.change_points(x) == list(range(1000, 100_000, 1000))


def test_breaks():
    rnd = np.random.RandomState(0)
    x = np.concatenate([rnd.normal(0, 0.1, 40), rnd.normal(3, 0.1, 40)])
    assert breaks.change_points(x) == [40] and breaks.change_points(rnd.normal(0, 1, 3)) == []


def test_apy(spark):
    rows = [(1, " rabi ", 1), (1, "Total", 2), (2, "Total", 3), (2, "Kharif", 4), (3, "Kharif", 5), (3, None, 6)]
    got = apy.preferred_season(spark.createDataFrame(rows, "f int, s string, v int"), ["f"], "s").collect()
    assert sorted((r.v, r.season_used) for r in got) == [(1, "Rabi"), (3, "Total"), (5, "Rabi"), (6, "Rabi")]
    panel = spark.createDataFrame([("a", y, 10.0 + y - 2006, 5.0, float(y - 2000)) for y in range(2006, 2012)] + [("b", 2006, None, None, 3.0)], "e string, year int, area double, production double, yield double")
    r = {x.e: x for x in apy.apy_features(panel, "e").collect()}
    assert len(r["a"].asDict()) == 22 and r["a"].apy_yield_trend_slope == pytest.approx(1) and r["a"].apy_yield_mk_tau == 1 and r["a"].apy_years_all_complete == 6 and r["a"].apy_cv_production == 0
    assert r["b"].apy_mean_area is None and r["b"].apy_yield_trend_slope is None and r["b"].apy_fraction_yield_observed == 0.05
    merged = apy.clean(spark.createDataFrame([("a", 1, -1.0, "x"), ("b", 1, 2.0, "y"), ("b", 1, 4.0, "x")], "e string, year int, m double, l string"), ["e", "year"], ["m"], "l")
    assert sorted((r.e, r.m, r.l) for r in merged.collect()) == [("a", None, "x"), ("b", 3.0, "x")]


def test_feature_counts(spark):
    rnd = np.random.RandomState(6)
    start = dt.date(2010, 1, 1)
    rows = [(e, start + dt.timedelta(days=d), float(20 + 10 * math.sin(d / 58) + e), float(8 + 10 * math.sin(d / 58)), float(max(0, rnd.normal(0, 30)))) for e in range(2) for d in range(0, 365 * 7, 2)]
    daily = spark.createDataFrame(rows, "e int, date date, tmax double, tmin double, rainfall double").withColumns({"tmean": (F.col("tmax") + F.col("tmin")) / 2, "year": F.year("date"), "month": F.month("date")})
    monthly = weather.monthly_weather(daily, "e")
    w = weather.weather_features(daily, spi.spi(monthly, "e", "monthly_rainfall"), "e").collect()
    assert len(w) == 2 and len(w[0].asDict()) == 117 and all(v is not None for v in w[0].asDict().values())
    yearly = weather.yearly_weather(daily, monthly, "e").where("e = 0").orderBy("year").collect()
    assert w[[r.e for r in w].index(0)].temperature_trend == pytest.approx(np.polyfit(range(len(yearly)), [r.avg_tmean for r in yearly], 1)[0])
    months = monthly.select("e", "year", "month", F.col("avg_tmax").alias("mean_modal_price"), F.col("avg_tmin").alias("mean_min_price"), F.col("avg_tmean").alias("mean_max_price"), F.lit(1.0).alias("mean_price_spread"), F.lit(0).alias("is_imputed"))
    p = price.price_features(months, "e").collect()
    assert len(p) == 2 and len(p[0].asDict()) == 65 and p[0].price_cv > 0 and p[0].fraction_extrapolated == 0


def test_means_around_zero(spark):
    """The sign of a mean does not depend on the order in which rows arrive: a small negative rest beside large values that cancel is negative."""
    large, rest = 2.0**39, -1e-6
    for k, order in enumerate(itertools.permutations([large, rest, -large])):
        rows = spark.createDataFrame([("a", 1, x, "x") for x in order], "e string, year int, m double, l string").coalesce(1)
        assert apy.clean(rows, ["e", "year"], ["m"], "l").first().m is None, k
        assert rows.agg(stats.exact_mean(F.col("m"))).first()[0] == rest / 3
    odd = spark.createDataFrame([(1, None), (2, 1e300), (2, 2.0), (3, float("nan")), (3, 1.0), (4, 0.1), (4, None), (4, -0.3), (5, 2.5)], "g int, x double")
    got = {r[0]: r[1] for r in odd.groupBy("g").agg(stats.exact_mean(F.col("x"))).collect()}
    assert got[1] is None and got[2] == 5e299 and math.isnan(got[3]) and got[4] == pytest.approx(-0.1, rel=1e-15) and got[5] == 2.5


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    cost = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    while len(groups) > k:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]] + groups[p[1]]) - cost(groups[p[0]]) - cost(groups[p[1]]))
        groups[a] += groups.pop(b)
    out = np.zeros(len(x), dtype=int)
    for label, g in enumerate(sorted(groups, key=min), start=1):
        out[g] = label
    return out


def test_clustering_in_blocks(spark):
    """Rows beyond one task's: Ward and silhouettes in pairs of blocks equal those of one array, outliers and null vectors included."""
    rnd = np.random.RandomState(9)
    x = np.concatenate([rnd.normal(c, 0.5, size=(30, 3)) for c in (0, 4, 9)] + [[[40, 0, 0], [43, 0, 0]]])[rnd.permutation(92)]
    v = spark.createDataFrame([(100 - i, p.tolist()) for i, p in enumerate(x)], "id int, v array<double>").repartition(3)
    tree = cluster.ward_tree(x[::-1])
    got = cluster.ward(v, "id", "v", [2, 4, 5], local=7, block=16).collect()
    for k in (2, 4, 5):
        assert [r.cluster for r in sorted(got) if r.k == k] == cluster.cut_tree(tree, k).tolist()
    with_null = v.withColumn("c", F.pmod("id", F.lit(3)).cast("string")).withColumn("v", F.when(F.col("id") % 10 > 0, F.col("v")))
    one, many = (sorted(map(tuple, cluster.silhouettes(with_null, "id", "v", "c", block=b).collect())) for b in (1000, 10))
    assert len(one) == 92 and [r[:2] for r in one] == [r[:2] for r in many] and [r[2] for r in one] == pytest.approx([r[2] for r in many])
    plan = cluster.silhouettes(v.withColumn("c", F.lit(1)), "id", "v", "c")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_clustering(spark):
    rnd = np.random.RandomState(8)
    x = np.concatenate([rnd.normal(c, 0.4, size=(8, 3)) for c in (0, 3, 7)])
    tree = cluster.ward_tree(x)
    assert (cluster.cut_tree(tree, 3) == brute_ward(x, 3)).all() and cluster.dendrogram_k(tree) in (2, 3) and cluster.choose_k(2, 3) == 2 and cluster.choose_k(2, 3, 5) == 5
    df = spark.createDataFrame([(i, *map(float, v), float(2 * v[0] + 1), 4.0, None if i < 10 else 1.0) for i, v in enumerate(x)], "id int, a double, b double, c double, d double, e double, f double")
    assert cluster.drop_missing(df, ["a", "f"]) == ["a"] and cluster.varied(df, ["a", "e"]) == ["a"] and cluster.uncorrelated(df, ["d", "a"]) == ["a"]
    assert df.agg(F.sum(F.col("f").isNull().cast("int"))).first()[0] == 10 and cluster.impute_medians(df, ["f"]).where("f is null").count() == 0
    z = cluster.standardise(df, ["a", "b", "c", "e"])
    r = z.agg(F.avg("a"), F.stddev_pop("a"), F.max("e")).first()
    assert list(r) == pytest.approx([0, 1, 0], abs=1e-12)
    out, loadings, explained = cluster.principal(z, ["a", "b", "c"])
    assert explained.sum() >= 0.9 and (loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] > 0).all() and len(out.first().pc) == len(explained)
    v = df.select("id", F.array("a", "b", "c").alias("v"))
    labels = cluster.ward(v, "id", "v", [3])
    s = {q.id: q.silhouette for q in cluster.silhouettes(labels.drop("k").join(v, "id"), "id", "v").collect()}
    own = cluster.cut_tree(tree, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        a = d[i, (own == own[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i, own == c].mean() for c in {1, 2, 3} - {own[i]})
        assert s[i] == pytest.approx((b - a) / max(a, b))
    with pytest.raises(ValueError):
        cluster.ward(v, "id", "v", [2], most_rows=5)
    with pytest.raises(ValueError):
        cluster.merge(v, v.union(v), key="id")
    assert cluster.flag_rows(df, ["a", "f", "e"]).where("flagged").count() == 10


def test_panel_checks_and_order(spark):
    rows = [("a", 2000, m, 1.0, 2, 0) for m in range(1, 13)] + [("a", 2000, 3, -1.0, -2, 0), ("b", 2000, 1, None, 0, 0), ("b", 2000, 2, 1.0, 0, None), ("b", 2000, 3, 1.0, 0, 1)]
    panel = spark.createDataFrame(rows, "entity string, year int, month int, p double, reporting_days int, is_imputed int")
    want = {"incomplete_years": 1, "repeated_months": 1, "missing_prices": 1, "negative_prices": 1, "negative_reports": 1, "unmarked_imputations": 2}
    assert {r.check: r.n for r in validate.panel_checks(panel, "entity", ("p",)).collect()} == want
    assert all(r.n == 0 for r in validate.panel_checks(panel.where("month > 90"), "entity", ("p",)).collect())
    placed = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 4), ("b", 1, 1)], "entity string, place int, t int")
    assert {r.entity: r.n for r in validate.out_of_order(placed, "entity", "place", F.col("t")).collect()} == {"a": 1, "b": 0}


def test_complete_audit(spark):
    files = spark.createDataFrame([("a", "2000.csv", 90), ("a", "2001.csv", 0), ("a", "2002.csv", 20), ("b", "2000.csv", 50)], "district string, filename string, size bigint")
    heads = spark.createDataFrame([("a", "2000.csv", ["date", "Market ID", "Min Price", "Max Price", "Modal Price", "notes"]), ("a", "2002.csv", ["Price Date"])], "district string, filename string, columns array<string>")
    rows = spark.createDataFrame([("a", "2000.csv", "1", "2000-01-02", "5", "4", "4")], "district string, filename string, market_id string, date string, min_price string, max_price string, modal_price string")
    got = {(r.district, r.filename): r for r in audit.complete(audit.audit(rows, 1995, 2005), files, heads).collect()}
    assert len(got) == 4
    flags = lambda r: [c for c in (*audit.CRITICAL, *audit.WARNING) if r[c]]
    assert flags(got["a", "2000.csv"]) == ["P5_price_inversion", "P6_modal_out_of_range", "C2_nonstandard_names", "C3_extra_cols"] and got["a", "2000.csv"].total_issues == 4
    assert flags(got["a", "2001.csv"]) == ["F2_empty_file"] and flags(got["b", "2000.csv"]) == ["F1_unreadable"]
    assert flags(got["a", "2002.csv"]) == ["F3_header_only", "C1_missing_cols", "C2_nonstandard_names"] and got["a", "2002.csv"].critical_issues == 2
    variants = {r.column_as_found: (r.maps_to_canonical, r.file_count) for r in audit.column_variants(heads).collect()}
    assert variants["notes"] == ("UNKNOWN", 1) and variants["Market ID"] == ("market_id", 1) and variants["Price Date"] == ("date", 1)
    done = audit.complete(audit.audit(rows, 1995, 2005), files, heads)
    assert [r.filename for r in audit.worst_files(done, 2).collect()] == ["2000.csv", "2002.csv"]
    assert [tuple(r) for r in audit.worst_entities(done, 1).collect()] == [("a", 8)]
    assert "2000.csv" in audit.report(done) and "F2_empty_file" in audit.report(done)


def test_components_explain_what_eigenvalues_say(spark):
    """Explained shares against NumPy's eigenvalues; a stored scaler and stored loadings give the same components again."""
    x = np.random.RandomState(0).normal(size=(60, 4)) @ np.diag([5, 2, 1, 0.5]) + 3
    x[:, 3] += x[:, 0]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, " + ", ".join(f"{c} double" for c in names))
    scaled = cluster.standardise(df, names)
    fitted, loadings, explained = cluster.principal(scaled, names, 0.9)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(explained, (values / values.sum())[: len(explained)]) and explained.sum() >= 0.9 > explained[:-1].sum()
    table, scaler = cluster.loadings_table(spark, names, loadings), cluster.scaler_table(df, names)
    again = {r.k: r.pc for r in cluster.project(df, scaler, table).collect()}
    assert all(np.allclose(again[r.k], r.pc) for r in fitted.collect())
    top = cluster.strongest_loadings(table, 2).where("component = 'PC1'").orderBy("rank").collect()
    assert [r.feature for r in top] == [names[i] for i in np.argsort(-np.abs(loadings[:, 0]), kind="stable")[:2]]
    assigned = spark.createDataFrame([(1,), (1,), (1,), (2,)], "cluster int")
    assert [tuple(r) for r in cluster.small_clusters(assigned).collect()] == [(2, 1)]


def test_daily_weather_keeps_days_that_all_series_have(spark):
    series_of = lambda *x: spark.createDataFrame(list(x), "entity string, date string, value double").withColumn("date", F.to_date("date"))
    tmax = series_of(("a", "2020-02-29", 30.0), ("a", "2020-03-01", 31.0), ("a", "2020-03-02", None))
    tmin = series_of(("a", "2020-02-29", 10.0), ("a", "2020-03-02", 9.0))
    rain = series_of(("a", "2020-02-29", -0.5), ("a", "2020-03-01", 1.0), ("a", "2020-03-02", 2.0))
    got = weather.daily_weather(tmax, tmin, rain, "entity").orderBy("date").collect()
    assert [(r.day, r.tmax, r.tmin, r.tmean, r.rainfall) for r in got] == [(29, 30.0, 10.0, 20.0, 0.0), (2, None, 9.0, None, 2.0)]


def test_quantiles_equal_numpy(spark):
    rnd = np.random.RandomState(1)
    x = [rnd.normal(size=3000), np.round(rnd.normal(size=3000), 1), np.repeat(7.0, 3000)]
    rows = [(i % 4, *(None if (i + k) % 5 == 0 else float(v[i]) for k, v in enumerate(x)), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, none double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = quantiles.of_columns(df, ["a", "b", "c", "none"], q, accuracy=50)
        want = {c: np.quantile([r[j] for r in rows if r[j] is not None], q) for j, c in ((1, "a"), (2, "b"), (3, "c"))}
        assert set(got) == set(want) and all(math.isclose(got[c], want[c], abs_tol=1e-12) for c in want)
    assert quantiles.of_columns(df.where("k > 9"), ["a"], 0.5) == {} and quantiles.of_columns(df, [], 0.5) == {}
    by = {r.k: (r.q1, r.n) for r in quantiles.of_groups(df.select("k", "a"), ["k"], "a", {"q1": 0.25}, "n").select("k", "q1", "n").distinct().collect()}
    for k, (q1, n) in by.items():
        own = [r[1] for r in rows if r[0] == k and r[1] is not None]
        assert n == len(own) and math.isclose(q1, np.quantile(own, 0.25), abs_tol=1e-12)


def test_silhouettes_of_many_and_wide_vectors(spark):
    """No number of rows is refused unless asked; distances by products are those by differences, for copies, near copies and far rows too."""
    rnd = np.random.RandomState(4)
    x = np.concatenate([rnd.normal(c, 0.5, size=(40, 12)) for c in (0, 3, 1000)])
    x[5], x[6], x[7] = x[4], x[4] + 1e-7, x[4] * (1 + 1e-15)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for a, got in cluster._distances(x, x[:90]):
        assert got == pytest.approx(d[a : a + len(got), :90], rel=1e-10) and got[4, 5] == 0
    v = spark.createDataFrame([(i, i // 40, p.tolist()) for i, p in enumerate(x)], "id int, cluster int, v array<double>")
    many = v.sparkSession.range(200_001).select(F.col("id").cast("int"), F.lit(0).alias("cluster"), F.array(F.lit(0.0)).alias("v"))
    assert cluster.silhouettes(many, "id", "v").columns == ["id", "cluster", "silhouette"]
    with pytest.raises(ValueError):
        cluster.silhouettes(v, "id", "v", most_rows=119)
    label = np.arange(120) // 40
    for block in (None, 13):
        for r in cluster.silhouettes(v, "id", "v", block=block).collect():
            a = d[r.id, (label == label[r.id]) & (np.arange(120) != r.id)].mean()
            b = min(d[r.id, label == c].mean() for c in set(range(3)) - {r.cluster})
            assert r.silhouette == pytest.approx((b - a) / max(a, b), rel=1e-9)


def test_ward_with_ties(spark, monkeypatch):
    """Copies of a vector and equal distances do not cost a round each, and give the clusters of one array."""
    rounds, pairs = [], cluster._pairs_of_blocks
    monkeypatch.setattr(cluster, "_pairs_of_blocks", lambda df, spread, n, block: rounds.append(n) or pairs(df, spread, n, block))
    x = [[10.0 * (i % 3), 0.0] for i in range(60)]
    copies = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>")
    got = cluster.ward(copies, "id", "v", [2, 3], local=7, block=16).collect()
    assert not rounds and [r.cluster for r in sorted(got) if r.k == 3] == [i % 3 + 1 for i in range(60)]
    assert {len({r.cluster for r in got if r.k == 2 and r.id % 3 == i}) for i in range(3)} == {1}
    line = spark.createDataFrame([(i, [float(i + 1000 * (i // 100))]) for i in range(200)], "id int, v array<double>")
    got = cluster.ward(line, "id", "v", [2], local=7, block=64).collect()
    assert len(rounds) < 25 and [r.cluster for r in sorted(got)] == [1 + i // 100 for i in range(200)]


def test_ward_input_is_made_once(spark):
    """What linkage and silhouettes read again and again is a table of one row an entity, not a plan over all of lineitem."""
    made = queries.centres(spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and "parquet" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in queries.supplier_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
