"""The registered queries of the panel operators and the SQL that checks them.

The tables have no districts, so operators run on analogues: nations by month, customers by year, users by day,
suppliers by year, embeddings as a feature matrix.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions import dates, numbers, special, stats
from .functions.rates import INFLATION
from .operators import audit, breaks, dedupe, fuzzy, gaps, geo, lookup, series, spi, validate
from .plans import apy, cluster, price, weather
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Added before rounding on both sides, so that halves (means of prices in cents) do not depend on an engine's last bit.
NUDGE = 1e-8


def _nudged(sql: str) -> str:
    """round(x, n) in the SQL as the Spark side rounds."""
    out, at = "", 0
    for m in re.finditer(r"(?<![A-Za-z_])round\(", sql):
        if m.start() < at:
            continue
        depth, comma, i = 1, None, m.end()
        while depth:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        if comma is None:
            continue
        out += f"{sql[at : m.start()]}(round(({sql[m.end() : comma]}) + {NUDGE}, {sql[comma + 1 : i - 1]}) + 0.0)"
        at = i
    return out + sql[at:]


def nudged(c: str, digits: int) -> Column:
    return (F.round(F.col(c) + NUDGE, digits) + 0.0).alias(c)


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = _nudged(sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT and doubles rounded, so that engines compare."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint"}
    return df.select(*[nudged(c, digits) if k == "double" else F.col(c).cast(kinds[k]).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


# --- price panels -----------------------------------------------------------------------------------------------------


def daily(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    p = F.col("o_totalprice")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"), p.alias("modal_price"), (p * 0.9).alias("min_price"), (p * 1.15).alias("max_price"))


DAILY = "daily AS (SELECT c_nationkey AS entity, o_orderdate::DATE AS date, o_totalprice AS modal_price, o_totalprice * 0.9::DOUBLE AS min_price, o_totalprice * 1.15::DOUBLE AS max_price FROM orders JOIN customer ON o_custkey = c_custkey)"
MONTHLY = f"""{DAILY}, monthly AS (SELECT entity, year(date) AS year, month(date) AS month, avg(modal_price) AS mean_modal_price, avg(min_price) AS mean_min_price,
 avg(max_price) AS mean_max_price, avg(max_price - min_price) AS mean_price_spread, count(DISTINCT date) AS reporting_days FROM daily GROUP BY ALL)"""


def _filled_sql() -> str:
    cols = ("mean_modal_price", "mean_min_price", "mean_max_price")
    own = "PARTITION BY entity, month ORDER BY year"
    carry = ", ".join(f"last_value(CASE WHEN NOT gone THEN {{'v': {c}}} END IGNORE NULLS) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a_{i}, lead(CASE WHEN NOT gone THEN {c} END) OVER ({own}) AS b_{i}" for i, c in enumerate(cols))
    whole = ", ".join(f"CASE WHEN gone THEN coalesce((a_{i}.v + b_{i}) / 2, a_{i}.v, b_{i}, {c}) ELSE {c} END AS w_{i}" for i, c in enumerate(cols))
    point = ", ".join(f"last_value(CASE WHEN w_{i} IS NOT NULL THEN {{'t': t, 'x': w_{i}}} END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_{i}, first_value(CASE WHEN w_{i} IS NOT NULL THEN {{'t': t, 'x': w_{i}}} END IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{i}" for i in range(len(cols)))
    line = ", ".join(f"coalesce(w_{i}, p_{i}.x + (n_{i}.x - p_{i}.x) * ((t - p_{i}.t)::DOUBLE / nullif(n_{i}.t - p_{i}.t, 0)), p_{i}.x, n_{i}.x) AS {c}" for i, c in enumerate(cols))
    return f"""{MONTHLY}, grid AS (SELECT entity, y AS year, m AS month, (y - 1995) * 12 + m AS t FROM (SELECT DISTINCT entity FROM monthly), range(1995, 2002) a(y), range(1, 13) b(m)),
g AS (SELECT grid.*, {", ".join(cols)}, coalesce(reporting_days, 0) AS reporting_days, (mean_modal_price IS NULL)::BIGINT AS is_imputed,
      bool_and(mean_modal_price IS NULL) OVER (PARTITION BY entity, year) AS gone FROM grid LEFT JOIN monthly USING (entity, year, month)),
c AS (SELECT *, {carry} FROM g), w AS (SELECT *, {whole} FROM c), p AS (SELECT *, {point} FROM w WINDOW o AS (PARTITION BY entity ORDER BY t)),
f AS (SELECT entity, year, month, t, reporting_days, is_imputed, {line} FROM p), filled AS (SELECT *, mean_max_price - mean_min_price AS mean_price_spread FROM f)"""


FILLED = _filled_sql()


def filled(spark: SparkSession, sf: str) -> DataFrame:
    panel = price.monthly_panel(daily(spark, sf), "entity").drop("mean_price_spread")
    out = gaps.fill_months(panel, "entity", 1995, 2001, ("mean_modal_price", "mean_min_price", "mean_max_price"), "mean_modal_price", "reporting_days")
    return out.withColumn("mean_price_spread", F.col("mean_max_price") - F.col("mean_min_price"))


@query(f"WITH {MONTHLY} SELECT entity::BIGINT AS entity, year::BIGINT AS year, month::BIGINT AS month, round(mean_modal_price, 4) AS mean_modal_price, round(mean_min_price, 4) AS mean_min_price, round(mean_max_price, 4) AS mean_max_price, round(mean_price_spread, 4) AS mean_price_spread, reporting_days FROM monthly")
def price_monthly_panel(spark, sf):
    return rounded(price.monthly_panel(daily(spark, sf), "entity"), 4)


@query(f"WITH {FILLED} SELECT entity::BIGINT AS entity, year::BIGINT AS year, month::BIGINT AS month, reporting_days, is_imputed, round(mean_modal_price, 4) AS mean_modal_price, round(mean_min_price, 4) AS mean_min_price, round(mean_max_price, 4) AS mean_max_price, round(mean_price_spread, 4) AS mean_price_spread FROM filled")
def month_gap_fill(spark, sf):
    return rounded(filled(spark, sf).select("entity", "year", "month", "reporting_days", "is_imputed", "mean_modal_price", "mean_min_price", "mean_max_price", "mean_price_spread"), 4)


def customer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated price rows in the years of the inflation table (eleven years later)."""
    date = F.add_months(F.col("o_orderdate").cast("date"), 132)
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", date.alias("date"), F.year(date).alias("year"), F.round("o_totalprice", 2).alias("price"))


CUSTOMER_ROWS = "r AS (SELECT o_custkey AS entity, o_orderkey, (o_orderdate + INTERVAL 132 MONTH)::DATE AS date, year(o_orderdate + INTERVAL 132 MONTH) AS year, round(o_totalprice, 2) AS price FROM orders)"
AS_OF = f"""{CUSTOMER_ROWS}, have AS (SELECT DISTINCT entity, year FROM r WHERE year BETWEEN 2006 AND 2012),
grid AS (SELECT entity, y AS year FROM (SELECT DISTINCT entity FROM have), range(2006, 2013) t(y)),
near_year AS (SELECT grid.entity, grid.year, coalesce(last_value(have.year IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(have.year IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS source_year
 FROM grid LEFT JOIN have ON have.entity = grid.entity AND have.year = grid.year WINDOW w AS (PARTITION BY grid.entity ORDER BY grid.year))"""


@query(f"WITH {AS_OF} SELECT entity, year::BIGINT AS year, source_year::BIGINT AS source_year FROM near_year")
def year_gap_carry(spark, sf):
    return rounded(gaps.as_of_year(customer_rows(spark, sf), "entity", 2006, 2012))


#: The rates a hair off, so that no product is exactly half a cent, which engines round by their last bit.
RATES = {y: round(r + 1.2345678e-7, 14) for y, r in INFLATION.items()}
_RATES = "MAP {" + ", ".join(f"{y}: {r!r}::DOUBLE" for y, r in RATES.items()) + "}"


@query(f"""WITH {AS_OF}, rates AS (SELECT {_RATES} AS rate), j AS (SELECT r.entity, o_orderkey, date, price, near_year.year AS y, source_year AS s FROM r JOIN near_year ON r.entity = near_year.entity AND r.year = source_year WHERE near_year.year <> source_year AND NOT (month(date) = 2 AND day(date) = 29))
SELECT entity, o_orderkey, make_date(y, month(date), day(date))::VARCHAR AS date, y::BIGINT AS year, round(CASE WHEN y > s THEN list_reduce(list_prepend(price, list_transform(range(s + 1, y + 1), lambda k: rate[k])), lambda a, q: round_even(a * (1 + q), 2))
 ELSE list_reduce(list_prepend(price, list_transform(list_reverse(range(y + 1, s + 1)), lambda k: rate[k])), lambda a, q: round_even(a / (1 + q), 2)) END, 1) AS price,
 (CASE WHEN s < y THEN y - 1 ELSE y + 1 END)::BIGINT AS imputed_from_year, true AS is_imputed FROM j, rates""")
def year_fill_inflation(spark, sf):
    made = gaps.fill_years(customer_rows(spark, sf), "entity", "date", ("price",), RATES, 2006, 2012)
    return rounded(made.withColumn("date", F.col("date").cast("string")), 1)


@query(f"""WITH {AS_OF}, n AS (SELECT entity, year, count(*) AS n, count(*) FILTER (month(date) = 2 AND day(date) = 29) AS n29 FROM r GROUP BY ALL)
SELECT a.entity, a.year::BIGINT AS year_filled, (CASE WHEN a.year > source_year THEN a.year - 1 ELSE a.year + 1 END)::BIGINT AS source_year, CASE WHEN a.year > source_year THEN 'forward' ELSE 'backward' END AS direction,
 n - n29 AS rows_written, CASE WHEN abs(a.year - source_year) = 1 THEN n29 ELSE 0 END AS rows_dropped_feb29 FROM near_year a JOIN n ON n.entity = a.entity AND n.year = source_year WHERE a.year <> source_year""")
def year_fill_log(spark, sf):
    return rounded(gaps.fill_log(customer_rows(spark, sf), "entity", "date", 2006, 2012))


SERIES = f"""{FILLED}, s0 AS (SELECT entity, year, month, t, is_imputed, mean_modal_price AS x, count(*) OVER e AS n, avg(mean_modal_price) OVER e AS mu, stddev_samp(mean_modal_price) OVER e AS sd FROM filled WINDOW e AS (PARTITION BY entity)),
s1 AS (SELECT *, CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END AS z, x - lag(x) OVER w AS diff, x / nullif(lag(x) OVER w, 0) - 1 AS ret, max(x) OVER w AS top,
 CASE WHEN count(x) OVER (w ROWS 2 PRECEDING) = 3 THEN stddev_samp(x) OVER (w ROWS 2 PRECEDING) END AS vol3, CASE WHEN count(x) OVER (w ROWS 5 PRECEDING) = 6 THEN stddev_samp(x) OVER (w ROWS 5 PRECEDING) END AS vol6 FROM s0 WINDOW w AS (PARTITION BY entity ORDER BY t)),
s2 AS (SELECT *, (x - top) / nullif(top, 0) AS fall, CASE WHEN t > 6 AND t <= n - 6 THEN (abs(avg(z) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) - avg(z) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) > 1.5)::INT ELSE 0 END AS shift,
 coalesce(diff > 0, false) AS pu, coalesce(diff < 0, false) AS pd, CASE WHEN diff <> 0 THEN sign(diff) END AS sg FROM s1 WINDOW w AS (PARTITION BY entity ORDER BY t)),
s3 AS (SELECT *, sum((NOT pu)::INT) OVER w AS gu, sum((NOT pd)::INT) OVER w AS gd, last_value(sg IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s2 WINDOW w AS (PARTITION BY entity ORDER BY t)),
s AS (SELECT *, sum(pu::INT) OVER (PARTITION BY entity, gu ORDER BY t) AS up, sum(pd::INT) OVER (PARTITION BY entity, gd ORDER BY t) AS down, coalesce((sg <> before)::INT, 0) AS turn FROM s3)"""


@query(f"WITH {SERIES} SELECT entity::BIGINT AS entity, t::BIGINT AS t, round(diff, 4) AS diff, round(ret, 6) AS ret, round(vol3, 4) AS vol3, round(vol6, 4) AS vol6, round(fall, 6) AS fall, shift::BIGINT AS shift, up::BIGINT AS up, down::BIGINT AS down, turn::BIGINT AS turn FROM s")
def price_series(spark, sf):
    s = price.with_series(filled(spark, sf), "entity", "mean_modal_price")
    return s.select(F.col("entity").cast("bigint").alias("entity"), F.col("t").cast("bigint").alias("t"), *[nudged(c, d) for c, d in (("diff", 4), ("ret", 6), ("vol3", 4), ("vol6", 4), ("fall", 6))], *[F.col(c).cast("bigint").alias(c) for c in ("shift", "up", "down", "turn")])


def _month_list(kind: str) -> str:
    return ", ".join(f"max({kind}) FILTER (month = {i + 1}) AS {m}_{kind}_price" for i, m in enumerate(price.MONTHS))


SEASONAL = f"""bm AS (SELECT entity, month, avg(x) AS avg, stddev_samp(x) AS std FROM s GROUP BY ALL),
se AS (SELECT entity, {_month_list("avg")}, {_month_list("std")}, max(avg) - min(avg) AS seasonal_amplitude, stddev_samp(avg) / nullif(avg(avg), 0) * 100 AS seasonal_cv, var_samp(avg) AS mvar,
 max(avg) / nullif(min(avg), 0) AS peak_to_trough_ratio, arg_max(month, {{'a': avg, 'm': -month}}) AS peak_price_month, arg_min(month, {{'a': avg, 'm': month}}) AS trough_price_month FROM bm GROUP BY entity),
by_y AS (SELECT entity, year, avg(x) AS avg, arg_max(month, {{'a': x, 'm': -month}}) AS peak, bool_and(is_imputed = 1) AS alli, bool_or(is_imputed = 1) AS anyi FROM s GROUP BY ALL)"""
PRICE_FEATURES_SQL = f"""WITH {SERIES}, {SEASONAL},
pr AS (SELECT a.entity, sum(sign(b.x - a.x)) AS sk FROM s a JOIN s b ON a.entity = b.entity AND a.t < b.t GROUP BY a.entity),
ti AS (SELECT entity, sum(k * (k - 1) / 2) AS t1, sum(k * (k - 1) * (2 * k + 5)) AS t2, sum(k) AS n FROM (SELECT entity, x, count(*) AS k FROM s GROUP BY ALL) GROUP BY entity),
ke AS (SELECT entity, sk / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - t1)) AS tau, abs(sk / sqrt((n * (n - 1) * (2 * n + 5) - t2) / 18)) / sqrt(2) AS zz FROM pr JOIN ti USING (entity)),
kp AS (SELECT entity, tau, zz, 1 / (1 + 0.3275911 * zz) AS q FROM ke),
ed AS (SELECT *, min(CASE WHEN is_imputed = 0 THEN t END) OVER e AS f0, max(CASE WHEN is_imputed = 0 THEN t END) OVER e AS l0, t - (n + 1) / 2 AS u FROM s WINDOW e AS (PARTITION BY entity)),
sp AS (SELECT entity, avg(mean_min_price) AS price_mean_min, avg(mean_max_price) AS price_mean_max, avg(mean_price_spread) AS price_mean_spread FROM filled GROUP BY entity),
l AS (SELECT entity, avg(x) AS price_mean_modal, median(x) AS price_median_modal, stddev_samp(x) AS price_std, stddev_samp(x) / nullif(avg(x), 0) * 100 AS price_cv, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS price_iqr,
 max(x) AS price_max_monthly, min(x) AS price_min_monthly, avg(vol3) AS price_rolling_vol_3m, avg(vol6) AS price_rolling_vol_6m, max(abs(diff)) AS price_max_monthly_change, avg(abs(diff)) AS price_mean_abs_monthly_change, var_samp(x) AS var,
 regr_slope(x, t) AS price_trend_linear_slope, (count(*) * sum(u * u * x) - sum(u * u) * sum(x)) / (count(*) * sum(u * u * u * u) - sum(u * u) * sum(u * u)) AS price_trend_quadratic_coef, sum(shift) AS structural_break_count,
 avg(ret) AS monthly_return_mean, median(ret) AS monthly_return_median, stddev_samp(ret) AS monthly_return_volatility, avg((ret > 0)::INT) * 100 AS pct_positive_months, max(up) AS longest_increasing_streak, max(down) AS longest_decreasing_streak,
 sum(turn) AS num_turning_points, -min(fall) * 100 AS max_drawdown, avg(is_imputed) * 100 AS pct_imputed, avg((is_imputed = 1 AND coalesce(t < f0 OR t > l0, true))::INT) * 100 AS fraction_extrapolated FROM ed GROUP BY entity),
yy AS (SELECT by_y.entity, pow(arg_max(avg, year) / arg_min(avg, year), 1.0::DOUBLE / (count(*) - 1)) - 1 AS price_cagr, avg((peak = peak_price_month)::INT) * 100 AS peak_month_consistency, count(*) FILTER (NOT alli) AS observed_years, count(*) FILTER (anyi) AS imputed_years, count(*) FILTER (alli) AS missing_years_before_imputation FROM by_y JOIN se USING (entity) GROUP BY by_y.entity),
o AS (SELECT l.* EXCLUDE (var), sp.* EXCLUDE (entity), se.* EXCLUDE (entity, mvar), yy.* EXCLUDE (entity), mvar / nullif(var, 0) AS seasonal_strength, tau AS mann_kendall_tau,
 q * (0.254829592 + q * (-0.284496736 + q * (1.421413741 + q * (-1.453152027 + q * 1.061405429)))) * exp(-zz * zz) AS mann_kendall_pvalue FROM l JOIN sp USING (entity) JOIN se USING (entity) JOIN yy USING (entity) JOIN kp USING (entity))
SELECT %s FROM o"""


def _price_columns() -> str:
    whole = ("entity", "structural_break_count", "longest_increasing_streak", "longest_decreasing_streak", "num_turning_points", "peak_price_month", "trough_price_month", "observed_years", "imputed_years", "missing_years_before_imputation")
    every = "price_mean_modal price_median_modal price_mean_min price_mean_max price_mean_spread price_std price_cv price_iqr price_max_monthly price_min_monthly price_rolling_vol_3m price_rolling_vol_6m price_max_monthly_change price_mean_abs_monthly_change price_trend_linear_slope price_trend_quadratic_coef monthly_return_mean monthly_return_median monthly_return_volatility pct_positive_months max_drawdown pct_imputed fraction_extrapolated seasonal_amplitude seasonal_cv peak_to_trough_ratio price_cagr peak_month_consistency seasonal_strength mann_kendall_tau mann_kendall_pvalue".split()
    every += [f"{m}_{k}_price" for m in price.MONTHS for k in ("avg", "std")]
    return ", ".join([f"{c}::BIGINT AS {c}" for c in whole] + [f"round({c}, 3) AS {c}" for c in every])


@query(PRICE_FEATURES_SQL % _price_columns())
def price_features(spark, sf):
    return rounded(price.price_features(filled(spark, sf), "entity"), 3)


@query(f"WITH {SERIES}, {SEASONAL} SELECT entity::BIGINT AS entity, {', '.join(f'round({m}_{k}_price, 4) AS {m}_{k}_price' for k in ('avg', 'std') for m in price.MONTHS)}, round(seasonal_amplitude, 4) AS seasonal_amplitude, round(seasonal_cv, 6) AS seasonal_cv, round(peak_to_trough_ratio, 6) AS peak_to_trough_ratio, peak_price_month::BIGINT AS peak_price_month, trough_price_month::BIGINT AS trough_price_month FROM se")
def seasonal_pivot(spark, sf):
    out = price.seasonal(filled(spark, sf), "entity", "mean_modal_price").drop("_month_var")
    return out.select(*[nudged(c, 6 if c in ("seasonal_cv", "peak_to_trough_ratio") else 4) if k == "double" else F.col(c).cast("bigint").alias(c) for c, k in out.dtypes])


@query()
def structural_breaks_pelt(spark, sf):
    return breaks.break_counts(filled(spark, sf), "entity", ["year", "month"], "mean_modal_price")


# --- area, production, yield ------------------------------------------------------------------------------------------


def supplier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-year metrics, each row of lineitem in one: by return flag, but that in some years one flag's rows go to the
    next metric, so that each metric lacks some keys."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    year = F.year("l_shipdate")
    metric = (flag + ((F.col("l_suppkey") + year) % 4 == flag).cast("int")) % 3
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), year.alias("year"), metric.alias("metric"), "l_quantity", "l_extendedprice")
    part = lambda i, v: l.where(F.col("metric") == i).groupBy("entity", "year").agg(v.alias("value"))
    return apy.outer_merge(
        ["entity", "year"],
        area=part(0, F.sum("l_quantity")),
        production=part(1, F.sum("l_extendedprice")),
        **{"yield": part(2, F.avg("l_extendedprice"))},
    )


METRICS = """f AS (SELECT l_suppkey AS entity, year(l_shipdate) AS year, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS f, l_quantity AS q, l_extendedprice AS p FROM lineitem),
l AS (SELECT entity, year, q, p, (f + ((entity + year) % 4 = f)::INT) % 3 AS k FROM f),
m AS (SELECT entity, year, area, production, yield FROM (SELECT entity, year, sum(q) AS area FROM l WHERE k = 0 GROUP BY ALL) FULL JOIN (SELECT entity, year, sum(p) AS production FROM l WHERE k = 1 GROUP BY ALL) USING (entity, year) FULL JOIN (SELECT entity, year, avg(p) AS yield FROM l WHERE k = 2 GROUP BY ALL) USING (entity, year))"""


@query(f"WITH {METRICS} SELECT entity, year::BIGINT AS year, round(area, 2) AS area, round(production, 2) AS production, round(yield, 2) AS yield FROM m")
def outer_merge_metrics(spark, sf):
    return rounded(supplier_metrics(spark, sf), 2)


def _growth_sql(c: str) -> str:
    v = f"list({{'t': year::DOUBLE, 'x': {c}}} ORDER BY year) FILTER ({c} IS NOT NULL)"
    return f"(SELECT CASE WHEN n >= 3 AND x0 > 0 AND t1 > t0 THEN pow(x1 / x0, 1.0::DOUBLE / (t1 - t0)) - 1 END FROM (SELECT n, CASE WHEN n >= 4 THEN (v[1].x + v[2].x) / 2 ELSE v[1].x END AS x0, CASE WHEN n >= 4 THEN (v[1].t + v[2].t) / 2 ELSE v[1].t END AS t0, CASE WHEN n >= 4 THEN (v[n-1].x + v[n].x) / 2 ELSE v[n].x END AS x1, CASE WHEN n >= 4 THEN (v[n-1].t + v[n].t) / 2 ELSE v[n].t END AS t1 FROM (SELECT v_{c} AS v, len(v_{c}) AS n)))"


def _apy_sql() -> str:
    lists = ", ".join(f"list({{'t': year::DOUBLE, 'x': {c}}} ORDER BY year) FILTER ({c} IS NOT NULL) AS v_{c}" for c in ("area", "production", "yield"))
    size = ", ".join(f"avg({c}) AS apy_mean_{c}, stddev_samp({c}) / nullif(avg({c}), 0) AS apy_cv_{c}, CASE WHEN count({c}) >= 5 THEN regr_slope({c}, year) END AS apy_{c}_trend_slope" for c in ("area", "production"))
    tau = "(SELECT CASE WHEN n >= 5 THEN sk / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - tied)) END FROM (SELECT len(v_yield) AS n, list_sum(list_transform(range(1, len(v_yield)), lambda i: list_sum(list_transform(v_yield[i+1:], lambda b: sign(b.x - v_yield[i].x))))) AS sk, len(v_yield) * 0 + list_sum(list_transform(range(1, len(v_yield) + 1), lambda i: len(list_filter(v_yield[i+1:], lambda b: b.x = v_yield[i].x)))) AS tied))"
    names = "apy_mean_yield apy_median_yield apy_std_yield apy_cv_yield apy_max_yield apy_min_yield apy_yield_range apy_yield_trend_slope apy_mean_area apy_cv_area apy_area_trend_slope apy_mean_production apy_cv_production apy_production_trend_slope apy_fraction_yield_observed".split()
    return f"""WITH {METRICS}, a AS (SELECT entity, avg(yield) AS apy_mean_yield, median(yield) AS apy_median_yield, stddev_samp(yield) AS apy_std_yield, stddev_samp(yield) / nullif(avg(yield), 0) AS apy_cv_yield, max(yield) AS apy_max_yield, min(yield) AS apy_min_yield, max(yield) - min(yield) AS apy_yield_range,
 CASE WHEN count(yield) >= 5 THEN regr_slope(yield, year) END AS apy_yield_trend_slope, {size}, {lists}, count(yield) AS apy_years_yield_observed, count(yield) / 20 AS apy_fraction_yield_observed, count(*) FILTER (area IS NOT NULL AND production IS NOT NULL AND yield IS NOT NULL) AS apy_years_all_complete FROM m GROUP BY entity)
SELECT entity, {", ".join(f"round({c}, 4) AS {c}" for c in names)}, apy_years_yield_observed, apy_years_all_complete, round({_growth_sql("area")}, 4) AS apy_area_cagr, round({_growth_sql("production")}, 4) AS apy_production_cagr, round({_growth_sql("yield")}, 4) AS apy_yield_cagr, round({tau}, 4) AS apy_yield_mk_tau FROM a"""


@query(_apy_sql())
def apy_features(spark, sf):
    return rounded(apy.apy_features(supplier_metrics(spark, sf), "entity"), 4)


@query("""WITH m AS (SELECT *, max(p_type = 'PROMO' AND p_size < 5) OVER (PARTITION BY p_brand, p_size) AS p, max(p_type = 'SMALL') OVER (PARTITION BY p_brand, p_size) AS f FROM part)
SELECT p_brand, p_size::BIGINT AS p_size, p_partkey, CASE WHEN NOT p AND f THEN 'Total' ELSE 'Rabi' END AS season_used FROM m WHERE CASE WHEN p THEN p_type = 'PROMO' AND p_size < 5 WHEN f THEN p_type = 'SMALL' ELSE true END""")
def season_fallback(spark, sf):
    season = F.when((F.col("p_type") == "PROMO") & (F.col("p_size") < 5), " rabi ").when(F.col("p_type") == "SMALL", "TOTAL").otherwise("Kharif")
    rows = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", season.alias("season"))
    return rounded(apy.preferred_season(rows, ["p_brand", "p_size"], "season").drop("season"))


@query("SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'FIRST' WHEN 'NATION_7' THEN 'SEVENTH' ELSE n_name END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def crosswalk_lookup(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return apy.crosswalk(rows, "n_name", {"NATION_1": "FIRST", "NATION_7": "SEVENTH"})


@query("""WITH a AS (SELECT l_suppkey AS entity, year(l_shipdate) AS year, avg(l_discount - 0.05::DOUBLE) AS rate, avg(l_quantity) AS quantity, min(l_returnflag) AS label FROM lineitem GROUP BY ALL)
SELECT entity, year::BIGINT AS year, round(CASE WHEN rate >= 0 THEN rate END, 6) AS rate, round(quantity, 6) AS quantity, label FROM a""")
def clean_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year"), (F.col("l_discount") - 0.05).alias("rate"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("label"))
    return rounded(apy.clean(rows, ["entity", "year"], ["rate", "quantity"], "label"))


# --- keys, sets, names ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unmatched_keys_anti(spark, sf):
    return lookup.unmatched(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), ["key"])


@query("""WITH r AS (SELECT DISTINCT o_custkey AS unit, year(o_orderdate) AS part FROM orders), d AS (SELECT DISTINCT o_custkey AS unit, year(o_orderdate) AS part FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT DISTINCT o_custkey AS unit, year(o_orderdate) AS part FROM orders WHERE o_orderpriority = '5-LOW'),
x AS (SELECT unit FROM r LEFT JOIN e USING (unit, part) GROUP BY unit HAVING count(*) = count(e.part))
SELECT unit, part::BIGINT AS part FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.unit = r.unit AND d.part = r.part) AND NOT EXISTS (SELECT 1 FROM e WHERE e.unit = r.unit AND e.part = r.part) AND unit NOT IN (SELECT unit FROM x)""")
def known_empty_semi(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("part"), "o_orderstatus", "o_orderpriority")
    pick = lambda df: df.select("unit", "part").distinct()
    return rounded(lookup.outstanding(pick(o), pick(o.where("o_orderstatus = 'F'")), pick(o.where("o_orderpriority = '5-LOW'")), ["unit"], "part"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'all three' AS kind, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b INTERSECT SELECT k FROM c) UNION ALL SELECT 'only first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b EXCEPT SELECT k FROM c)""")
def set_ops(spark, sf):
    k = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    a, b, c = k("F"), k("O"), k("P")
    every = a.intersect(b).intersect(c).select(F.lit("all three").alias("kind"), "k")
    return every.unionByName(a.subtract(b).subtract(c).select(F.lit("only first").alias("kind"), "k"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 500 = 0 THEN '#' || p_partkey ELSE replace(p_name, ' ', '') END AS name FROM part), c AS (SELECT DISTINCT p_name AS candidate FROM part),
s AS (SELECT name, candidate, 100 * (1 - levenshtein(lower(name), lower(candidate))::DOUBLE / greatest(length(name), length(candidate), 1)) AS score FROM n, c),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS rank FROM s)
SELECT name, rank, candidate, round(score, 6) AS score FROM r WHERE rank <= 5""")
def fuzzy_topk(spark, sf):
    p = table(spark, sf, "part")
    # a few names share no two letters with any candidate
    names = p.select(F.when(F.col("p_partkey") % 500 == 0, F.concat(F.lit("#"), F.col("p_partkey").cast("string"))).otherwise(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"))
    return rounded(fuzzy.top(names, p.select(F.col("p_name").alias("candidate"))))


# --- duplicates and audit ---------------------------------------------------------------------------------------------

KEYS = ["l_orderkey", "l_linenumber"]
DUP = """d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 > 0 THEN round(l_quantity) END AS low, CASE WHEN l_partkey % 5 > 0 THEN round(l_quantity) + 5 END AS modal, round(l_quantity) + 10 AS high,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem),
g AS (SELECT *, (low IS NOT NULL)::INT + (modal IS NOT NULL)::INT + (high IS NOT NULL)::INT AS n FROM d)"""


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    q = F.round("l_quantity")
    order = Window.partitionBy(*KEYS).orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, sf, "lineitem").select(*KEYS, F.when(F.col("l_suppkey") % 7 > 0, q).alias("low"), F.when(F.col("l_partkey") % 5 > 0, q + 5).alias("modal"), (q + 10).alias("high"), F.row_number().over(order).alias("pos"))


@query(f"""WITH {DUP} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS rows, CASE WHEN count(DISTINCT {{'a': low, 'b': modal, 'c': high}}) = 1 THEN 'exact' WHEN min(n) <> max(n) THEN 'missing value'
 WHEN greatest(count(DISTINCT low), count(DISTINCT modal), count(DISTINCT high)) > 1 THEN 'price conflict' ELSE 'mixed' END AS type FROM g GROUP BY ALL HAVING count(*) > 1""")
def dedupe_classify(spark, sf):
    return rounded(dedupe.classify(duplicates(spark, sf).drop("pos"), KEYS, ["low", "modal", "high"]))


@query(f"""WITH {DUP}, a AS (SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT {{'a': low, 'b': modal, 'c': high}}) AS k, min(n) AS n0, max(n) AS n1, arg_min({{'a': low, 'b': modal, 'c': high}}, pos) AS f, arg_max({{'a': low, 'b': modal, 'c': high}}, n * 1000000 - pos) AS m, min(low) AS lo, max(high) AS hi FROM g GROUP BY ALL),
h AS (SELECT *, CASE WHEN rows = 1 THEN 'single' WHEN k = 1 THEN 'exact' WHEN n0 <> n1 THEN 'fullest' ELSE 'merged' END AS how FROM a)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, rows, how, CASE how WHEN 'merged' THEN lo WHEN 'fullest' THEN m.a ELSE f.a END AS low, CASE how WHEN 'merged' THEN round_even((lo + hi) / 2, 0) WHEN 'fullest' THEN m.b ELSE f.b END AS modal, CASE how WHEN 'merged' THEN hi WHEN 'fullest' THEN m.c ELSE f.c END AS high FROM h""")
def dedupe_resolve(spark, sf):
    return rounded(dedupe.resolve(duplicates(spark, sf), KEYS, "pos", "low", "high", "modal"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, count(*) OVER k > 1 AS duplicated, row_number() OVER (k ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) > 1 AS again FROM lineitem WINDOW k AS (PARTITION BY l_orderkey, l_linenumber)""")
def duplicate_masks(spark, sf):
    l = table(spark, sf, "lineitem")
    return rounded(l.select(*KEYS, "l_partkey", dedupe.duplicated(KEYS).alias("duplicated"), dedupe.repeats(KEYS, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).alias("again")))


def price_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text rows of files, one a nation and year, with faults by order key."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    amount = F.format_number("o_totalprice", 2)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("district"),
        F.concat((F.year(d) + F.when(F.col("c_nationkey") == 3, 1).otherwise(0)).cast("string"), F.lit(".csv")).alias("filename"),
        (F.col("o_custkey") % 5).cast("string").alias("market_id"),
        F.when(k % 101 == 0, "bad").when(k % 7 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("date"),
        F.when(k % 97 == 0, "n/a").when(k % 89 == 0, "-5").otherwise(amount).alias("min_price"),
        F.when(k % 83 == 0, "0").otherwise(amount).alias("max_price"),
        F.when(k % 79 == 0, "1").otherwise(amount).alias("modal_price"),
    )


FILES = """x AS (SELECT c_nationkey::VARCHAR AS district, (year(o_orderdate) + (c_nationkey = 3)::INT)::VARCHAR || '.csv' AS filename, (o_custkey % 5)::VARCHAR AS market_id, o_orderkey AS k, o_orderdate::DATE AS d, round(o_totalprice, 2) AS p FROM orders JOIN customer ON o_custkey = c_custkey),
y AS (SELECT *, CASE WHEN k % 101 = 0 THEN 'bad' WHEN k % 7 = 0 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%Y-%m-%d') END AS dt, CASE WHEN k % 101 <> 0 THEN d END AS pd, CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN -5 ELSE p END AS lo, CASE WHEN k % 83 = 0 THEN 0 ELSE p END AS hi, CASE WHEN k % 79 = 0 THEN 1 ELSE p END AS mo, left(filename, 4)::INT AS fy FROM x),
z AS (SELECT *, count(*) OVER (PARTITION BY district, filename, dt, market_id) > 1 AS twice FROM y)"""


@query(f"""WITH {FILES}, a AS (SELECT district, filename, count(*) AS n_rows, count(pd) > 0 AND NOT coalesce(bool_or(year(pd) = fy), false) AS "F4_year_mismatch", count(pd) = 0 AS "D1_date_unparseable", count(pd) > 0 AND count(pd) < count(*) AS "D2_invalid_dates", count(*) - count(pd) AS n_invalid_dates,
 count(*) FILTER (year(pd) NOT BETWEEN 1995 AND 2000) AS n_out_of_range_dates, count(*) FILTER (twice) AS n_duplicate_dates, bool_or(k % 97 = 0) AS "P1_non_numeric_prices", coalesce(bool_or(lo < 0), false) AS "P2_negative_prices", bool_or(hi = 0) AS "P3_zero_prices", count(*) FILTER (lo > hi) AS n_price_inversions, count(*) FILTER (mo < lo OR mo > hi) AS n_modal_violations,
 bool_or(k % 7 = 0 AND k % 101 <> 0) AND bool_or(k % 7 <> 0 AND k % 101 <> 0) AS "D4_mixed_date_formats" FROM z GROUP BY ALL)
SELECT * FROM a""")
def audit_file_flags(spark, sf):
    found = audit.audit(price_files(spark, sf), 1995, 2000)
    return rounded(found.select("district", "filename", "n_rows", "F4_year_mismatch", "D1_date_unparseable", "D2_invalid_dates", "n_invalid_dates", "n_out_of_range_dates", "n_duplicate_dates", "P1_non_numeric_prices", "P2_negative_prices", "P3_zero_prices", "n_price_inversions", "n_modal_violations", "D4_mixed_date_formats"))


FLAGS = ("F4_year_mismatch", "D1_date_unparseable", "D2_invalid_dates", "D3_dates_out_of_range", "D5_duplicate_dates", "P1_non_numeric_prices", "P2_negative_prices", "P5_price_inversion", "P6_modal_out_of_range", "D4_mixed_date_formats", "P3_zero_prices", "P4_price_outliers", "K1_suspicious_jumps")
AUDITED = f"""{FILES}, v AS (SELECT district, filename, 1 AS kind, lo AS v FROM z UNION ALL SELECT district, filename, 2, hi FROM z UNION ALL SELECT district, filename, 3, mo FROM z),
q AS (SELECT district, filename, kind, count(v) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM v GROUP BY ALL),
o AS (SELECT district, filename, count(*) FILTER (n >= 4 AND (v < a - 3 * (b - a) OR v > b + 3 * (b - a))) AS n_out FROM v JOIN q USING (district, filename, kind) GROUP BY ALL),
d AS (SELECT district, filename, market_id, pd, mo, abs(mo - lag(mo) OVER w) AS d, count(*) OVER (PARTITION BY district, filename, market_id) AS n FROM z WINDOW w AS (PARTITION BY district, filename, market_id ORDER BY pd NULLS FIRST, mo)),
m AS (SELECT *, CASE WHEN count(d) OVER w >= 3 THEN quantile_cont(d, 0.5) OVER w END AS m FROM d WINDOW w AS (PARTITION BY district, filename, market_id ORDER BY pd NULLS FIRST, mo ROWS 6 PRECEDING)),
k AS (SELECT district, filename, count(*) FILTER (n >= 5 AND m > 0 AND d > 3 * m) AS n_jumps FROM m GROUP BY ALL),
a AS (SELECT district, filename, count(pd) > 0 AND NOT coalesce(bool_or(year(pd) = fy), false) AS "F4_year_mismatch", count(pd) = 0 AS "D1_date_unparseable", count(pd) > 0 AND count(pd) < count(*) AS "D2_invalid_dates",
 count(*) FILTER (year(pd) NOT BETWEEN 1995 AND 2000) > 0 AS "D3_dates_out_of_range", count(*) FILTER (twice) > 0 AS "D5_duplicate_dates", bool_or(k % 97 = 0) AS "P1_non_numeric_prices", coalesce(bool_or(lo < 0), false) AS "P2_negative_prices",
 count(*) FILTER (lo > hi) > 0 AS "P5_price_inversion", count(*) FILTER (mo < lo OR mo > hi) > 0 AS "P6_modal_out_of_range", bool_or(k % 7 = 0 AND k % 101 <> 0) AND bool_or(k % 7 <> 0 AND k % 101 <> 0) AS "D4_mixed_date_formats", bool_or(hi = 0) AS "P3_zero_prices" FROM z GROUP BY ALL),
f AS (SELECT a.*, n_out > 0 AS "P4_price_outliers", n_jumps > 0 AS "K1_suspicious_jumps" FROM a JOIN o USING (district, filename) JOIN k USING (district, filename)),
t AS (SELECT *, {" + ".join(f'"{c}"::INT' for c in FLAGS[:9])} AS critical, {" + ".join(f'"{c}"::INT' for c in FLAGS[9:])} AS warning FROM f)"""


@query(f"""WITH {AUDITED} {" UNION ALL ".join(f"SELECT '{c}' AS flag, count(*) FILTER ({chr(34)}{c}{chr(34)}) AS files FROM f" for c in FLAGS)}""")
def audit_summary(spark, sf):
    return audit.summary(audit.audit(price_files(spark, sf), 1995, 2000))


@query(f"WITH {AUDITED} SELECT district, filename, (critical + warning)::BIGINT AS total_issues FROM t WHERE critical + warning > 0 ORDER BY critical DESC, warning DESC, district, filename LIMIT 20")
def audit_worst_files(spark, sf):
    return rounded(audit.worst_files(audit.audit(price_files(spark, sf), 1995, 2000)))


@query(f"WITH {AUDITED} SELECT district, sum(critical + warning)::BIGINT AS total_issues FROM t GROUP BY district ORDER BY total_issues DESC, district LIMIT 15")
def audit_worst_entities(spark, sf):
    return audit.worst_entities(audit.audit(price_files(spark, sf), 1995, 2000))


@query("""WITH d AS (SELECT o_custkey % 50 AS k, o_orderkey AS i, CASE WHEN o_orderkey % 97 = 0 THEN ' ' WHEN o_orderkey % 31 = 0 THEN 'soon' WHEN o_custkey % 50 < 25 AND o_orderkey % 5 = 0 THEN 'dd/MM/yyyy' WHEN o_orderkey % 11 = 0 THEN 'yyyy/MM/dd' ELSE 'yyyy-MM-dd' END AS f FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM d WHERE trim(f) <> '')
SELECT k, coalesce(string_agg(DISTINCT f, '|' ORDER BY f) FILTER (f <> 'soon'), '') AS formats FROM n WHERE n <= 200 GROUP BY k""")
def date_format_sample(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    shape = lambda p: F.date_format(d, p)
    date = F.when(k % 97 == 0, " ").when(k % 31 == 0, "soon").when((F.col("o_custkey") % 50 < 25) & (k % 5 == 0), shape("dd/MM/yyyy")).when(k % 11 == 0, shape("yyyy/MM/dd")).otherwise(shape("yyyy-MM-dd"))
    return audit.sampled_formats(table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k"), k.alias("i"), date.alias("date")), ["k"], "i")


@query("""WITH d AS (SELECT c_mktsegment AS district, trim(CASE WHEN c_custkey % 10 = 0 THEN ' other ' || c_custkey % 3 WHEN c_custkey % 10 = 1 THEN lower(c_mktsegment) WHEN c_custkey % 10 > 2 THEN c_mktsegment END) AS name FROM customer)
SELECT district, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM d WHERE lower(name) <> lower(district) GROUP BY district""")
def mismatched_names(spark, sf):
    k = F.col("c_custkey") % 10
    name = F.when(k == 0, F.concat(F.lit(" other "), (F.col("c_custkey") % 3).cast("string"))).when(k == 1, F.lower("c_mktsegment")).when(k > 2, F.col("c_mktsegment"))
    return audit.mismatched_names(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("district"), name.alias("district_name")))


@query("""WITH v AS (SELECT l_suppkey AS k, CASE WHEN l_orderkey % 7 > 0 THEN l_discount END AS lo, CASE WHEN l_orderkey % 5 > 0 THEN l_tax END AS hi FROM lineitem)
SELECT k, 'lenient' AS kind, count(*) AS n FROM v WHERE coalesce(lo <> 0, true) AND coalesce(hi <> 0, true) GROUP BY k UNION ALL SELECT k, 'strict', count(*) FROM v WHERE lo <> 0 AND hi <> 0 GROUP BY k""")
def zero_price_filters(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.when(F.col("l_orderkey") % 7 > 0, F.col("l_discount")).alias("lo"), F.when(F.col("l_orderkey") % 5 > 0, F.col("l_tax")).alias("hi"))
    parts = [dedupe.without_zero_prices(v, "lo", "hi", strict).withColumn("kind", F.lit("strict" if strict else "lenient")) for strict in (False, True)]
    return parts[0].unionByName(parts[1]).groupBy("k", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {MONTHLY}, s AS (SELECT entity, year, month, CASE WHEN month <> 7 THEN mean_modal_price - 150000 END AS a, mean_min_price AS b, mean_max_price AS c, reporting_days - 2 AS r, month % 2 AS i FROM monthly WHERE entity % 4 > 0 OR month <> 3),
p AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE month = 5 AND entity % 3 = 0)
SELECT 'incomplete_years' AS "check", count(*) AS n FROM (SELECT 1 FROM p GROUP BY entity, year HAVING count(DISTINCT month) <> 12)
UNION ALL SELECT 'repeated_months', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM p GROUP BY entity, year, month)
UNION ALL SELECT 'missing_prices', count(*) FILTER (a IS NULL) + count(*) FILTER (b IS NULL) + count(*) FILTER (c IS NULL) FROM p
UNION ALL SELECT 'negative_prices', count(*) FILTER (a < 0) + count(*) FILTER (b < 0) + count(*) FILTER (c < 0) FROM p
UNION ALL SELECT 'negative_reports', count(*) FILTER (r < 0) FROM p UNION ALL SELECT 'unmarked_imputations', count(*) FILTER (r = 0 AND i IS DISTINCT FROM 1) FROM p""")
def panel_checks(spark, sf):
    m = price.monthly_panel(daily(spark, sf), "entity").where((F.col("entity") % 4 > 0) | (F.col("month") != 3))
    s = m.select("entity", "year", "month", F.when(F.col("month") != 7, F.col("mean_modal_price") - 150000).alias("a"), F.col("mean_min_price").alias("b"), F.col("mean_max_price").alias("c"), (F.col("reporting_days") - 2).alias("reporting_days"), (F.col("month") % 2).alias("is_imputed"))
    return validate.panel_checks(s.unionByName(s.where((F.col("month") == 5) & (F.col("entity") % 3 == 0))), "entity", ("a", "b", "c"))


@query("""WITH o AS (SELECT o_custkey AS entity, year(o_orderdate) * 12 + month(o_orderdate) AS t, lag(year(o_orderdate) * 12 + month(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT entity, count(*) FILTER (t < b) AS n FROM o GROUP BY entity""")
def months_out_of_order(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", "o_orderdate")
    return validate.out_of_order(o, "entity", "o_orderkey", F.year("o_orderdate") * 12 + F.month("o_orderdate"))


@query("""WITH p AS (SELECT DISTINCT c_nationkey AS entity, year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT entity::BIGINT AS entity, year FROM p WHERE entity % 5 = 0 OR year % 3 = 0""")
def writable_targets(spark, sf):
    o = daily(spark, sf).select("entity", F.year("date").alias("year"))
    planned = o.distinct()
    files = planned.where(F.col("year") % 3 != 0)
    return rounded(tables.writable(planned, files, o.where(F.col("entity") % 5 != 0), ["entity", "year"]))


@query("""WITH v AS (SELECT l_suppkey % 50 AS k, l_extendedprice * CASE WHEN l_partkey % 200 = 0 THEN 10 ELSE 1 END AS v FROM lineitem), q AS (SELECT k, count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM v GROUP BY k)
SELECT k, count(*) FILTER (n >= 4 AND (v < a - 3 * (b - a) OR v > b + 3 * (b - a))) AS n_outliers FROM v JOIN q USING (k) GROUP BY k""")
def iqr_outliers(spark, sf):
    v = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), (F.col("l_extendedprice") * F.when(F.col("l_partkey") % 200 == 0, 10).otherwise(1)).alias("v"))
    return audit.outlier_bounds(v, ["k"], "v")


@query("""WITH d AS (SELECT o_custkey AS k, o_orderdate, o_orderkey, abs(o_totalprice - lag(o_totalprice) OVER w) AS d, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
m AS (SELECT *, CASE WHEN count(d) OVER w >= 3 THEN quantile_cont(d, 0.5) OVER w END AS m FROM d WINDOW w AS (PARTITION BY k ORDER BY o_orderdate, o_orderkey ROWS 6 PRECEDING))
SELECT k, count(*) FILTER (n >= 5 AND m > 0 AND d > 3 * m) AS n_jumps FROM m GROUP BY k""")
def rolling_mad_jumps(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", "o_totalprice")
    return audit.jumps(o, ["k"], ["o_orderdate", "o_orderkey"], "o_totalprice")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders)
SELECT k, CASE k % 6 WHEN 0 THEN 'yyyy-MM-dd' WHEN 1 THEN 'dd/MM/yyyy' WHEN 2 THEN 'dd-MM-yyyy' WHEN 3 THEN 'yyyy/MM/dd' WHEN 4 THEN 'yyyyMMdd' END AS format, CASE WHEN k % 6 < 5 THEN d::VARCHAR END AS date,
 (year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0)) AS leap, CASE WHEN NOT (month(d) = 2 AND day(d) = 29) THEN make_date(2003, month(d), day(d))::VARCHAR END AS in_2003, year(d)::BIGINT AS name_year, (year(d) + 1)::BIGINT AS crop_year FROM d""")
def date_functions(spark, sf):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    text = F.coalesce(*[F.when(k % 6 == i, F.date_format(d, p)) for i, p in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyyMMdd"))], F.lit("31st of May"))
    name = F.concat(F.lit("area_"), F.year(d).cast("string"), F.lit(".csv"))
    crop = F.concat(F.year(d).cast("string"), F.lit("-"), F.substring((F.year(d) + 1).cast("string"), 3, 2))
    return rounded(table(spark, sf, "orders").select(k.alias("k"), dates.date_format(text).alias("format"), dates.parse_date(text).cast("string").alias("date"), dates.is_leap(F.year(d)).alias("leap"), dates.in_year(d, F.lit(2003)).cast("string").alias("in_2003"), dates.year_in_name(name).alias("name_year"), dates.crop_year(crop).alias("crop_year")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 > 0 THEN round(o_totalprice, 2) END AS number, round_even((floor(o_totalprice) + floor(o_totalprice) + o_orderkey % 4) / 2, 0) AS middle FROM orders")
def numeric_coerce(spark, sf):
    text = F.when(F.col("o_orderkey") % 11 == 0, "NR").otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    whole = F.floor("o_totalprice").cast("double")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), numbers.to_number(text).alias("number"), numbers.midpoint(whole, whole + F.col("o_orderkey") % 4).alias("middle"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# --- weather ----------------------------------------------------------------------------------------------------------


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Users as places: days of events, two years' worth of calendar squeezed from event ids, with temperature and rain."""
    e = table(spark, sf, "events")
    date = F.date_add(F.lit("2021-01-01").cast("date"), (F.col("event_id") % 1096).cast("int"))
    d = e.groupBy((F.col("user_id") % 20).alias("entity"), date.alias("date")).agg(F.max(F.least(F.col("value") / 8, F.lit(45.0))).alias("tmax"), F.min(F.col("value") / 10).alias("tmin"), F.sum(F.when(F.col("event_type") != "view", F.col("value") / 4)).alias("rainfall"))
    return d.withColumns({"tmean": (F.col("tmax") + F.col("tmin")) / 2, "year": F.year("date"), "month": F.month("date")})


USER_DAYS = """u AS (SELECT user_id % 20 AS entity, DATE '2021-01-01' + (event_id % 1096)::INT AS date, max(least(value / 8, 45)) AS tmax, min(value / 10) AS tmin, sum(CASE WHEN event_type <> 'view' THEN value / 4 END) AS rainfall FROM events GROUP BY ALL),
w AS (SELECT *, (tmax + tmin) / 2 AS tmean, year(date) AS year, month(date) AS month FROM u)"""
_HDD = ", ".join(f"sum(greatest(0, {b} - tmean)) AS HDD_{b}" for b in weather.HDD_BASES)


@query(f"""WITH {USER_DAYS}, m AS (SELECT entity, year, month, avg(tmax) AS avg_tmax, avg(tmin) AS avg_tmin, avg(tmean) AS avg_tmean, coalesce(sum(rainfall), 0) AS monthly_rainfall, count(*) FILTER (rainfall >= 2.5) AS rainy_days, {_HDD} FROM w GROUP BY ALL)
SELECT entity, year::BIGINT AS year, month::BIGINT AS month, round(avg_tmax, 6) AS avg_tmax, round(avg_tmin, 6) AS avg_tmin, round(avg_tmean, 6) AS avg_tmean, round(monthly_rainfall, 6) AS monthly_rainfall, rainy_days, round(HDD_10, 6) AS "HDD_10", round(HDD_15, 6) AS "HDD_15", round(HDD_18, 6) AS "HDD_18" FROM m""")
def weather_monthly(spark, sf):
    return rounded(weather.monthly_weather(user_days(spark, sf), "entity"))


@query(f"""WITH {USER_DAYS}, m AS (SELECT entity, year, avg(tmax) AS avg_tmax, avg(tmin) AS avg_tmin, avg(tmean) AS avg_tmean, max(tmax) AS max_tmax, min(tmin) AS min_tmin, coalesce(sum(rainfall), 0) AS annual_rainfall, count(*) FILTER (rainfall >= 2.5) AS rainy_days, count(*) FILTER (rainfall >= 64.5) AS heavy_rain_days, count(*) FILTER (rainfall >= 115.6) AS very_heavy_rain_days, {_HDD} FROM w GROUP BY ALL)
SELECT entity, year::BIGINT AS year, round(avg_tmax, 6) AS avg_tmax, round(avg_tmin, 6) AS avg_tmin, round(avg_tmean, 6) AS avg_tmean, round(max_tmax, 6) AS max_tmax, round(min_tmin, 6) AS min_tmin, round(annual_rainfall, 6) AS annual_rainfall, rainy_days, heavy_rain_days, very_heavy_rain_days, round(HDD_10, 6) AS "HDD_10", round(HDD_15, 6) AS "HDD_15", round(HDD_18, 6) AS "HDD_18" FROM m""")
def weather_yearly(spark, sf):
    d = user_days(spark, sf)
    return rounded(weather.yearly_weather(d, weather.monthly_weather(d, "entity"), "entity"))


@query(f"""WITH {USER_DAYS}, m AS (SELECT entity, year, month, coalesce(sum(rainfall), 0) AS r FROM w GROUP BY ALL), c AS (SELECT entity, month, avg(r) AS p FROM m GROUP BY ALL),
a AS (SELECT entity, arg_max(month, {{'p': p, 'm': -month}}) AS peak, 12 * sum(p * p) / (sum(p) * sum(p)) AS rci FROM c GROUP BY entity), b AS (SELECT entity, count(*) FILTER (rainfall >= 2.5) / count(*) AS wet, count(*) FILTER (rainfall >= 64.5) / count(*) AS heavy, count(*) FILTER (rainfall >= 115.6) / count(*) AS very FROM w GROUP BY entity),
g AS (SELECT *, coalesce(rainfall < 2.5, false) AS dry, row_number() OVER (PARTITION BY entity ORDER BY date) - row_number() OVER (PARTITION BY entity, coalesce(rainfall < 2.5, false) ORDER BY date) AS g FROM w),
s AS (SELECT entity, max(n) AS dry FROM (SELECT entity, g, count(*) AS n FROM g WHERE dry GROUP BY ALL) GROUP BY entity)
SELECT a.entity, peak::BIGINT AS rainfall_peak_month, round(rci, 6) AS rainfall_concentration_index, round(wet, 6) AS rainfall_wet_day_frequency, round(heavy, 6) AS rainfall_heavy_rain_frequency, round(very, 6) AS rainfall_very_heavy_frequency, coalesce(s.dry, 0) AS rainfall_longest_dry_spell FROM a JOIN b USING (entity) LEFT JOIN s USING (entity)""")
def rainfall_concentration(spark, sf):
    d = user_days(spark, sf)
    m = weather.monthly_weather(d, "entity")
    out = weather.rainfall_features(weather.yearly_weather(d, m, "entity"), m, d, "entity")
    return rounded(out.select("entity", "rainfall_peak_month", "rainfall_concentration_index", "rainfall_wet_day_frequency", "rainfall_heavy_rain_frequency", "rainfall_very_heavy_frequency", "rainfall_longest_dry_spell"))


def user_spi(spark: SparkSession, sf: str) -> DataFrame:
    """SPI of customers' monthly order counts over seven years: enough years a calendar month for a fit."""
    m = daily(spark, sf).groupBy("entity", F.year("date").alias("year"), F.month("date").alias("month")).agg((F.sum("modal_price") / 1000).alias("rain"))
    grid = gaps.month_grid(m, "entity", 1995, 2001).join(m, ["entity", "year", "month"], "left")
    return spi.spi(grid, "entity", "rain")


def _number(x: float) -> str:
    return f"({x!r})" if "e" in repr(x) else f"({x!r}e0)"


def _spi_sql(source: str, scales: tuple[int, ...] = (1, 3)) -> str:
    """CTEs that end in `spi` (entity, year, month, rain, SPI1, SPI3), from a CTE `source` (entity, year, month, rain)."""
    horner = lambda r, c: _number(c[0]) if len(c) == 1 else f"({_number(c[0])} + {r} * {horner(r, c[1:])})"
    y = "(k + 10)"
    series = lambda c: horner(f"(1 / ({y} * {y}))", c)
    digamma = f"(ln({y}) - 0.5e0 / {y} - {series((1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132))} / ({y} * {y}) - {' - '.join(f'1 / (k + {i})' for i in range(10))})"
    trigamma = f"(1 / {y} + 0.5e0 / ({y} * {y}) + {series((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66))} / ({y} * {y} * {y}) + {' + '.join(f'1 / ((k + {i}) * (k + {i}))' for i in range(10))})"
    step = f"((ln(k) - {digamma} - s) / (1 / k - {trigamma}))"
    start = "(3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)"
    shape = f"CASE WHEN n < 5 THEN NULL WHEN s <= 1e-12 THEN 1e6 ELSE list_reduce(list_prepend({start}, range(12)::DOUBLE[]), lambda k, i: CASE WHEN k > {step} THEN k - {step} ELSE k / 2 END) END"
    terms = "ceil(greatest(x - a, 0) + 10 * sqrt(greatest(x, a)) + 40)::BIGINT"
    total = f"list_reduce(list_transform(range(0, {terms} + 1), lambda n: {{'n': n::DOUBLE, 'term': 1 / a, 'total': 1 / a}}), lambda t, e: {{'n': e.n, 'term': t.term * x / (a + e.n), 'total': t.total + t.term * x / (a + e.n)}}).total"
    cdf = f"CASE WHEN x <= 0 THEN 0 WHEN x > a + 100 + 12 * sqrt(a) THEN 1 ELSE least(1, exp(a * ln(x) - x - lgamma(a)) * {total}) END"
    ratio = lambda r, t: f"{horner(r, t[0])} / {horner(r, t[1])}"
    q, tail = "(p - 0.5e0)", "sqrt(-ln(least(p, 1 - p)))"
    normal = f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {ratio(f'(0.180625e0 - {q} * {q})', special.CENTRE)} ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {ratio(f'({tail} - 1.6e0)', special.MIDDLE)} ELSE {ratio(f'({tail} - 5)', special.FAR)} END END"
    w = lambda s: f"(PARTITION BY entity ORDER BY year, month ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)"
    rolled = ", ".join(f"CASE WHEN count(rain) OVER {w(s)} = {s} THEN sum(rain) OVER {w(s)} END AS r{s}" for s in scales)
    out = [f"rolled AS (SELECT *, {rolled} FROM {source})"]
    for s in scales:
        r = f"r{s}"
        out += [
            f"st{s} AS (SELECT entity, month, count({r}) FILTER ({r} > 0) AS n, avg({r}) FILTER ({r} > 0) AS mean, ln(avg({r}) FILTER ({r} > 0)) - avg(CASE WHEN {r} > 0 THEN ln({r}) END) AS s, count(*) FILTER ({r} = 0) / count(*) AS zeros FROM rolled GROUP BY ALL)",
            f"ft{s} AS (SELECT entity, month, mean, zeros, {shape} AS a FROM st{s})",
            f"xs{s} AS (SELECT entity, year, month, zeros, a, {r} / (mean / a) AS x FROM rolled JOIN ft{s} USING (entity, month) WHERE a IS NOT NULL AND {r} IS NOT NULL)",
            f"ps{s} AS (SELECT entity, year, month, least(greatest(CASE WHEN x <= 0 THEN zeros ELSE zeros + (1 - zeros) * ({cdf}) END, 1e-6), 1 - 1e-6) AS p FROM xs{s})",
            f"zs{s} AS (SELECT entity, year, month, {normal} AS SPI{s} FROM ps{s})",
        ]
    joins = " ".join(f"LEFT JOIN zs{s} USING (entity, year, month)" for s in scales)
    return ", ".join([*out, f"spi AS (SELECT entity, year, month, rain, {', '.join(f'SPI{s}' for s in scales)} FROM rolled {joins})"])


SPI_FEATURES = """sd AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year, month) AS t FROM spi),
sg AS (SELECT *, t - row_number() OVER (PARTITION BY entity, coalesce(SPI1 < -1, false) ORDER BY t) AS gd, t - row_number() OVER (PARTITION BY entity, coalesce(SPI1 > 1, false) ORDER BY t) AS gw FROM sd),
sr AS (SELECT *, CASE WHEN SPI1 < -1 THEN row_number() OVER (PARTITION BY entity, gd, coalesce(SPI1 < -1, false) ORDER BY t) ELSE 0 END AS d, CASE WHEN SPI1 > 1 THEN row_number() OVER (PARTITION BY entity, gw, coalesce(SPI1 > 1, false) ORDER BY t) ELSE 0 END AS w FROM sg),
sf AS (SELECT entity, avg(SPI1) AS spi1_mean, median(SPI1) AS spi1_median, stddev_samp(SPI1) AS spi1_std,
 avg((SPI1 > -1 AND SPI1 <= -0.5)::INT) AS spi1_mild_drought_freq, avg((SPI1 > -1.5 AND SPI1 <= -1)::INT) AS spi1_moderate_drought_freq, avg((SPI1 <= -1.5)::INT) AS spi1_severe_drought_freq, avg((SPI1 > 1)::INT) AS spi1_wet_freq,
 max(d)::BIGINT AS spi1_longest_drought_spell, max(w)::BIGINT AS spi1_longest_wet_spell, coalesce(count(*) FILTER (SPI1 < -1) / nullif(count(*) FILTER (d = 1), 0), 0) AS spi1_avg_drought_duration,
 min(SPI1) AS spi1_min, max(SPI1) AS spi1_max, avg(SPI1) FILTER (month IN MONSOON_MONTHS) AS spi1_mean_monsoon, avg(SPI1) FILTER (month IN RABI_MONTHS) AS spi1_mean_rabi FROM sr GROUP BY entity)""".replace("MONSOON_MONTHS", str(weather.MONSOON)).replace("RABI_MONTHS", str(weather.RABI))
SPI_NAMES = ("mean", "median", "std", "mild_drought_freq", "moderate_drought_freq", "severe_drought_freq", "wet_freq", "longest_drought_spell", "longest_wet_spell", "avg_drought_duration", "min", "max", "mean_monsoon", "mean_rabi")
SPI_COLUMNS = ", ".join(f"spi1_{c}" if c.startswith("longest") else f"round(spi1_{c}, 6) AS spi1_{c}" for c in SPI_NAMES)
USER_SPI = f"{DAILY}, um AS (SELECT entity, year(date) AS year, month(date) AS month, sum(modal_price) / 1000 AS rain FROM daily GROUP BY ALL), gg AS (SELECT entity, y AS year, m AS month FROM (SELECT DISTINCT entity FROM um), range(1995, 2002) a(y), range(1, 13) b(m)), ug AS (SELECT gg.*, rain FROM gg LEFT JOIN um USING (entity, year, month)), {_spi_sql('ug')}"


@query(f"WITH {USER_SPI} SELECT entity::BIGINT AS entity, year::BIGINT AS year, month::BIGINT AS month, round(rain, 6) AS rain, round(SPI1, 6) AS SPI1, round(SPI3, 6) AS SPI3 FROM spi")
def spi_scores(spark, sf):
    return rounded(user_spi(spark, sf))


def _weather_sql(with_spi: bool) -> str:
    """All features, or all but those of the SPI, by plain groupings of days, months and years."""
    cv = lambda x: f"stddev_samp({x}) / nullif(avg({x}), 0)"
    positive = lambda x: f"CASE WHEN avg({x}) > 0 THEN {cv(x)} END"
    slope = lambda x: f"CASE WHEN count({x}) >= 3 THEN regr_slope({x}, i) END"
    growth = lambda x: f"CASE WHEN arg_min({x}, year) > 0 AND arg_max({x}, year) > 0 AND count(*) > 1 THEN pow(arg_max({x}, year) / arg_min({x}, year), 1.0::DOUBLE / (count(*) - 1)) - 1 END"
    months = lambda name: "month IN (" + ", ".join(map(str, getattr(weather, name))) + ")"
    within = lambda name, x: f"CASE WHEN {months(name)} THEN {x} END"
    temps = ("tmax", "tmin", "tmean")
    by_year = {
        **{f"temperature_{n}_{c}": f"{f}(avg_{c})" for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp")) for c in temps},
        **{f"temperature_cv_{c}": cv(f"avg_{c}") for c in temps},
        "temperature_max_tmax": "max(max_tmax)", "temperature_min_tmin": "min(min_tmin)", "temperature_max_tmean": "max(avg_tmean)", "temperature_min_tmean": "min(avg_tmean)",
        "temperature_trend": slope("avg_tmean"), "temperature_cagr": growth("avg_tmean"),
        "rainfall_mean_annual": "avg(rain)", "rainfall_median_annual": "median(rain)", "rainfall_std_annual": "stddev_samp(rain)", "rainfall_cv_annual": positive("rain"), "rainfall_max_annual": "max(rain)",
        "rainfall_avg_rainy_days": "avg(rainy)", "rainfall_trend": slope("rain"), "rainfall_cagr": growth("rain"), "rainfall_anomaly_index": "0.0::DOUBLE",
        "climate_temp_variance": "var_samp(avg_tmean)", "climate_rain_variance": "var_samp(rain)", "climate_hdd_variance": "var_samp(HDD_18)",
        "climate_warmest_year": "(list(year ORDER BY avg_tmean DESC, year))[1]::BIGINT", "climate_coldest_year": "(list(year ORDER BY avg_tmean, year))[1]::BIGINT",
        "climate_wettest_year": "(list(year ORDER BY rain DESC, year))[1]::BIGINT", "climate_driest_year": "(list(year ORDER BY rain, year))[1]::BIGINT",
        "climate_temp_stability": f"1 / (1 + {cv('avg_tmean')})", "climate_rain_stability": f"1 / (1 + ({positive('rain')}))", "climate_hdd_stability": f"1 / (1 + ({positive('HDD_18')}))",
    }
    by_month = {
        "temperature_avg_diurnal_range": "avg(avg_tmax - avg_tmin)",
        **{f"temperature_mean_{n.lower()}": f"avg({within(n, 'avg_tmean')})" for n in ("WINTER", "SUMMER")},
        **{f"temperature_cv_{n.lower()}": cv(within(n, "avg_tmean")) for n in ("WINTER", "SUMMER")},
        "temperature_summer_winter_diff": f"avg({within('SUMMER', 'avg_tmean')}) - avg({within('WINTER', 'avg_tmean')})",
        "rainfall_mean_monthly": "avg(rain)", "rainfall_std_monthly": "stddev_samp(rain)", "rainfall_cv_monthly": positive("rain"), "rainfall_max_monthly": "max(rain)", "rainfall_min_monthly": "min(rain)",
    }
    for b in weather.HDD_BASES:
        x, p = f"HDD_{b}", f"hdd{b}_"
        by_year |= {
            p + "mean": f"avg({x})", p + "median": f"median({x})", p + "std": f"stddev_samp({x})", p + "cv": positive(x), p + "max": f"max({x})", p + "min": f"min({x})",
            p + "nonzero_freq": f"count(*) FILTER ({x} > 0) / count(*)", p + "high_freq": f"count(*) FILTER ({x} > m_{b}) / count(*)", p + "trend": slope(x), p + "variability_index": positive(x),
            p + "persistence": f"max(s_{b})::BIGINT", p + "anomaly": "0.0::DOUBLE",
        }
        by_month |= {f"{p}{n.lower()}_share": f"CASE WHEN sum({x}) > 0 THEN coalesce(sum({within(n, x)}), 0) / sum({x}) END" for n in ("WINTER", "SUMMER")}
    by_season = {"rainfall_mean_monsoon": "avg(m)", "rainfall_mean_non_monsoon": "avg(o)", "rainfall_monsoon_cv": positive("m")}
    by_climate = {"rainfall_peak_month": "(list(month ORDER BY p DESC, month))[1]::BIGINT", "rainfall_concentration_index": "CASE WHEN sum(p) > 0 THEN 12 * sum(p * p) / (sum(p) * sum(p)) END"}
    by_day = {"rainfall_wet_day_frequency": "count(*) FILTER (rainfall >= 2.5) / count(*)", "rainfall_heavy_rain_frequency": "count(*) FILTER (rainfall >= 64.5) / count(*)", "rainfall_very_heavy_frequency": "count(*) FILTER (rainfall >= 115.6) / count(*)", "rainfall_longest_dry_spell": "max(s)::BIGINT"}
    # a run's rows differ from their numbers among all rows that hold by a constant
    run = lambda holds, order, keep: f"CASE WHEN {holds} THEN row_number() OVER (PARTITION BY entity, g{keep}, coalesce({holds}, false) ORDER BY {order}) ELSE 0 END AS s{keep}"
    island = lambda holds, order, keep: f"row_number() OVER (PARTITION BY entity ORDER BY {order}) - row_number() OVER (PARTITION BY entity, coalesce({holds}, false) ORDER BY {order}) AS g{keep}"
    hdd = ", ".join(f"sum(greatest(0, {b} - tmean)) AS HDD_{b}" for b in weather.HDD_BASES)
    listed = lambda d: ", ".join(f"{x} AS {c}" for c, x in d.items())
    whole = {c: c if x.endswith("::BIGINT") else f"round({c}, 6)" for d in (by_year, by_month, by_season, by_climate, by_day) for c, x in d.items()}
    whole["rainfall_monsoon_share"] = "round(CASE WHEN rainfall_mean_annual > 0 THEN rainfall_mean_monsoon / rainfall_mean_annual END, 6)"
    parts = ("temperature_cv_tmean", "rainfall_cv_annual", f"hdd{weather.PRIMARY_HDD}_cv", "spi1_std")
    spi_parts = f", {_spi_sql('mo')}, {SPI_FEATURES}\n" if with_spi else "\n"
    spi_columns = f", {SPI_COLUMNS}, round(1 / (1 + spi1_std), 6) AS climate_spi_stability, round(list_avg([{', '.join(parts)}]), 6) AS climate_variability_score" if with_spi else ""
    spi_join = " JOIN sf USING (entity)" if with_spi else ""
    return f"""WITH {USER_DAYS},
mo AS (SELECT entity, year, month, avg(tmax) AS avg_tmax, avg(tmin) AS avg_tmin, avg(tmean) AS avg_tmean, coalesce(sum(rainfall), 0) AS rain, {hdd} FROM w GROUP BY ALL),
ye AS (SELECT entity, year, avg(tmax) AS avg_tmax, avg(tmin) AS avg_tmin, avg(tmean) AS avg_tmean, max(tmax) AS max_tmax, min(tmin) AS min_tmin, coalesce(sum(rainfall), 0) AS rain, count(*) FILTER (rainfall >= 2.5) AS rainy, {hdd} FROM w GROUP BY ALL),
y1 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year) - 1 AS i, {", ".join(f"avg(HDD_{b}) OVER (PARTITION BY entity) AS m_{b}" for b in weather.HDD_BASES)} FROM ye),
y2 AS (SELECT *, {", ".join(island(f"HDD_{b} > m_{b}", "year", f"_{b}") for b in weather.HDD_BASES)} FROM y1),
y3 AS (SELECT *, {", ".join(run(f"HDD_{b} > m_{b}", "year", f"_{b}") for b in weather.HDD_BASES)} FROM y2),
d2 AS (SELECT *, {island("rainfall < 2.5", "date", "")} FROM w), d3 AS (SELECT *, {run("rainfall < 2.5", "date", "")} FROM d2),
sh AS (SELECT entity, year, sum({within("MONSOON", "rain")}) AS m, sum({within("NON_MONSOON", "rain")}) AS o FROM mo GROUP BY ALL),
cl AS (SELECT entity, month, avg(rain) AS p FROM mo GROUP BY ALL),
a AS (SELECT entity, {listed(by_year)} FROM y3 GROUP BY entity), b AS (SELECT entity, {listed(by_month)} FROM mo GROUP BY entity), c AS (SELECT entity, {listed(by_season)} FROM sh GROUP BY entity),
d AS (SELECT entity, {listed(by_climate)} FROM cl GROUP BY entity), e AS (SELECT entity, {listed(by_day)} FROM d3 GROUP BY entity){spi_parts}SELECT entity, {listed(whole)}{spi_columns} FROM a JOIN b USING (entity) JOIN c USING (entity) JOIN d USING (entity) JOIN e USING (entity){spi_join}"""


@query(_weather_sql(True))
def weather_features(spark, sf):
    d = user_days(spark, sf)
    return rounded(weather.weather_features(d, spi.spi(weather.monthly_weather(d, "entity"), "entity", "monthly_rainfall"), "entity"))


@query(_weather_sql(False))
def weather_features_without_spi(spark, sf):
    found = weather_features(spark, sf)
    return found.select(*[c for c in found.columns if not c.startswith("spi1_") and c not in ("climate_spi_stability", "climate_variability_score")])


@query(f"WITH {USER_SPI}, {SPI_FEATURES} SELECT entity::BIGINT AS entity, {SPI_COLUMNS} FROM sf")
def spi_spells(spark, sf):
    return rounded(weather.spi_features(user_spi(spark, sf), "entity"))


# --- clustering -------------------------------------------------------------------------------------------------------

DIMS = [f"f{i:02d}" for i in range(64)]


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 64 feature columns; f63 follows f62 closely and f61 hardly varies."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(DIMS)])
    return e.withColumns({"f63": F.col("f62") * 2 + F.col("f63") * 0.01, "f61": F.col("f61") * 1e-5 + 1})


MATRIX = "x AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i:02d}" for i in range(64)) + " FROM embeddings), mx AS (SELECT vec_id, label, " + ", ".join(f"e{i:02d} AS f{i:02d}" for i in range(61)) + ", e61 * 1e-5 + 1 AS f61, e62 AS f62, e62 * 2 + e63 * 0.01 AS f63 FROM x)"
LONG = f"{MATRIX}, lo AS (UNPIVOT mx ON {', '.join(DIMS)} INTO NAME feature VALUE v)"


@query(f"WITH {LONG} SELECT feature, round(CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / abs(avg(v)) WHEN stddev_samp(v) = 0 THEN 0 END, 3) AS cv FROM lo GROUP BY feature")
def variance_filter(spark, sf):
    return rounded(cluster.variation(matrix(spark, sf), DIMS), 3)


@query(f"WITH {LONG} SELECT a.feature AS a, b.feature AS b, round(corr(a.v, b.v), 6) AS r FROM lo a JOIN lo b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL")
def correlation_pairs(spark, sf):
    r = cluster.correlations(matrix(spark, sf), DIMS)
    pairs = [(DIMS[i], DIMS[j], float(r[i, j])) for i in range(64) for j in range(i + 1, 64)]
    return rounded(spark.createDataFrame(pairs, "a string, b string, r double"))


@query(f"WITH {LONG}, hi AS (SELECT * FROM lo WHERE v >= -0.1) SELECT a.feature AS a, b.feature AS b, round(CASE WHEN count(*) > 1 THEN corr(a.v, b.v) END, 6) AS r FROM hi a JOIN hi b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL")
def correlation_with_gaps(spark, sf):
    m = matrix(spark, sf)
    gaps_in = m.select(*[F.when(F.col(c) >= -0.1, F.col(c)).alias(c) for c in DIMS])
    r = cluster.correlations(gaps_in, DIMS)
    pairs = [(DIMS[i], DIMS[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(64) for j in range(i + 1, 64)]
    return rounded(spark.createDataFrame(pairs, "a string, b string, r double"))


@query(f"""WITH RECURSIVE {LONG}, p AS (SELECT a.feature AS a, b.feature AS b FROM lo a JOIN lo b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL HAVING abs(corr(a.v, b.v)) > 0.95)
SELECT feature FROM (SELECT DISTINCT feature FROM lo) WHERE feature NOT IN (SELECT b FROM p)""")
def corr_prune(spark, sf):
    return spark.createDataFrame([(c,) for c in cluster.uncorrelated(matrix(spark, sf), DIMS)], "feature string")


@query(f"WITH {LONG} SELECT vec_id, feature, round((v - avg(v) OVER f) / stddev_pop(v) OVER f, 4) AS z FROM lo WINDOW f AS (PARTITION BY feature)")
def standardize(spark, sf):
    s = cluster.standardise(matrix(spark, sf), DIMS)
    return rounded(s.unpivot(["vec_id"], DIMS, "feature", "z"), 4)


@query()
def pca_variance(spark, sf):
    _, _, explained = cluster.principal(cluster.standardise(matrix(spark, sf), DIMS), DIMS)
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(explained)], "component int, explained double")


def centres(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier feature vectors: entities few enough for Ward. They are made once; medians, scales and vectors are read from them."""
    f = cut(apy.apy_features(supplier_metrics(spark, sf), "entity").select("entity", "apy_mean_area", "apy_mean_production", "apy_mean_yield"))
    names = f.columns[1:]
    return cluster.standardise(cluster.impute_medians(f, names), names).select("entity", F.array(*names).alias("v"))


@query()
def ward_cut(spark, sf):
    return cluster.ward(centres(spark, sf), "entity", "v", [2, 3, 4])


@query()
def ward_silhouette(spark, sf):
    c = centres(spark, sf)
    return cluster.silhouettes(cluster.ward(c, "entity", "v", [3]).drop("k").join(c, "entity"), "entity", "v")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label AS c, b.label AS c2, sum(list_distance(a.v, b.v)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
n AS (SELECT vec_id, c, max(CASE WHEN c = c2 THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> c2 THEN d / n END) AS b FROM d GROUP BY ALL)
SELECT vec_id, c::BIGINT AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM n""")
def silhouette(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(cluster.silhouettes(e, "vec_id", "v", "label"))


@query(f"WITH {MATRIX} SELECT label::BIGINT AS label, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in DIMS)} FROM mx GROUP BY ROLLUP (label)")
def cluster_profile_rollup(spark, sf):
    return rounded(cluster.profiles(matrix(spark, sf), DIMS, "label"))


ZSCORES = f"{LONG}, w AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM lo GROUP BY feature), z AS (SELECT label, feature, (avg(v) - any_value(m)) / nullif(any_value(s), 0) AS z FROM lo JOIN w USING (feature) GROUP BY ALL)"


@query(f"WITH {ZSCORES} SELECT label::BIGINT AS label, feature, round(z, 4) AS z, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, feature) AS rank FROM z) WHERE rank <= 5")
def zscore_topk(spark, sf):
    return rounded(cluster.strongest(cluster.profile_scores(matrix(spark, sf), DIMS, "label"), "label"), 4)


@query(f"WITH {ZSCORES} SELECT feature, round(max(abs(z)), 4) AS most FROM z GROUP BY feature HAVING max(abs(z)) > 0.05 ORDER BY max(abs(z)) DESC, feature LIMIT 50")
def standout_features(spark, sf):
    return rounded(cluster.standout(cluster.profile_scores(matrix(spark, sf), DIMS, "label"), 0.05), 4)


@query(f"WITH {METRICS} SELECT feature, round(missing, 6) AS missing FROM (SELECT avg((area IS NULL)::INT) AS area, avg((production IS NULL)::INT) AS production, avg((yield IS NULL)::INT) AS yield FROM m) UNPIVOT (missing FOR feature IN (area, production, yield))")
def missing_fraction(spark, sf):
    return rounded(cluster.missing_fractions(supplier_metrics(spark, sf), ["area", "production", "yield"]))


@query(f"WITH {METRICS} SELECT entity, year::BIGINT AS year, round(coalesce(area, median(area) OVER ()), 4) AS area, round(coalesce(production, median(production) OVER ()), 4) AS production, round(coalesce(yield, median(yield) OVER ()), 4) AS yield FROM m")
def median_impute(spark, sf):
    return rounded(cluster.impute_medians(supplier_metrics(spark, sf), ["area", "production", "yield"]), 4)


# --- grids and polygons -----------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", (F.lit(70.03) + (F.col("c_custkey") * 7 % 101) / 10).alias("lon"), (F.lit(20.07) + (F.col("c_custkey") * 13 % 97) / 10).alias("lat"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle for each nation, some of which overlap."""
    k = F.col("n_nationkey")
    x, y = 70 + 2 * (k % 5), 20 + 2 * F.floor(k / 5)
    corner = lambda a, b: F.struct(a.cast("double").alias("lon"), b.cast("double").alias("lat"))
    return table(spark, sf, "nation").select("n_name", F.array(corner(x, y), corner(x + 2.5, y), corner(x + 2.5, y + 2), corner(x, y + 2)).alias("ring"))


PLACES = "pt AS (SELECT c_custkey, 70.03::DOUBLE + (c_custkey * 7 % 101)::DOUBLE / 10 AS lon, 20.07::DOUBLE + (c_custkey * 13 % 97)::DOUBLE / 10 AS lat FROM customer)"


@query(f"WITH {PLACES}, b AS (SELECT n_name, 70 + 2 * (n_nationkey % 5) AS x, 20 + 2 * (n_nationkey // 5) AS y FROM nation) SELECT c_custkey, n_name FROM pt LEFT JOIN b ON lon >= x AND lon < x + 2.5 AND lat > y AND lat < y + 2")
def grid_point_in_rect(spark, sf):
    return geo.contained(points(spark, sf), boxes(spark, sf)).select("c_custkey", "n_name")


@query(f"""WITH {PLACES}, g AS (SELECT i AS lat_idx, j AS lon_idx, 20.0 + i AS la, 70.0 + j AS lo FROM range(0, 9) a(i), range(0, 9) b(j))
SELECT c_custkey, arg_min(lat_idx, {{'d': round((lat - la) ** 2 + (lon - lo) ** 2, 9), 'i': lat_idx, 'j': lon_idx}}) AS lat_idx, arg_min(lon_idx, {{'d': round((lat - la) ** 2 + (lon - lo) ** 2, 9), 'i': lat_idx, 'j': lon_idx}}) AS lon_idx FROM pt, g GROUP BY c_custkey""")
def nearest_cell(spark, sf):
    p = points(spark, sf)
    cells = geo.grid(spark.range(1), 20.0, 70.0, 9, 9)
    return rounded(geo.nearest_cell(p, cells, 20.0, 70.0, 9, 9).select("c_custkey", "lat_idx", "lon_idx"))


# --- days of weather out of three series, clusters on a map --------------------------------------------------------------


@query("""WITH e AS (SELECT user_id % 50 AS entity, ts::DATE AS date, event_id % 3 AS kind, value FROM events),
x AS (SELECT entity, date, max(value) AS v FROM e WHERE kind = 0 GROUP BY ALL), n AS (SELECT entity, date, min(value) AS v FROM e WHERE kind = 1 GROUP BY ALL), r AS (SELECT entity, date, sum(value) - 100 AS v FROM e WHERE kind = 2 GROUP BY ALL)
SELECT entity, date::VARCHAR AS date, year(date) AS year, month(date) AS month, day(date) AS day, round(x.v, 6) AS tmax, round(n.v, 6) AS tmin, round((x.v + n.v) / 2, 6) AS tmean, round(greatest(r.v, 0), 6) AS rainfall FROM x JOIN n USING (entity, date) JOIN r USING (entity, date)""")
def daily_weather_join(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("entity"), F.col("ts").cast("date").alias("date"), (F.col("event_id") % 3).alias("kind"), "value")
    series_of = lambda k, value: e.where(F.col("kind") == k).groupBy("entity", "date").agg(value.alias("value"))
    days = weather.daily_weather(series_of(0, F.max("value")), series_of(1, F.min("value")), series_of(2, F.sum("value") - 100), "entity")
    return rounded(days.withColumn("date", F.col("date").cast("string")))


@query("""WITH s AS (SELECT 'e' || s_suppkey AS e, s_nationkey + 1 AS cluster, CASE WHEN s_suppkey = 7 THEN 's7' ELSE 'e' || s_suppkey END AS place, 75 + (s_suppkey % 120) / 10.0::DOUBLE AS lon, 23 + (s_suppkey % 90) / 10.0::DOUBLE AS lat FROM supplier WHERE s_suppkey % 11 > 0)
SELECT place, cluster::BIGINT AS cluster, round(lon, 6) AS lon, round(lat, 6) AS lat FROM s WHERE lon > 76 AND lon < 85.5 AND lat > 23.5 AND lat < 31.5 AND NOT (place = 'e50' AND lat > 27) AND NOT (place = 'e60' AND lon < 77)""")
def clusters_on_map(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    entity = F.concat(F.lit("e"), k.cast("string"))
    places = s.select(F.when(k == 7, "s7").otherwise(entity).alias("place"), (75 + (k % 120) / 10).alias("lon"), (23 + (k % 90) / 10).alias("lat"))
    joined = cluster.on_map(places, s.where(k % 11 > 0).select(entity.alias("entity"), (F.col("s_nationkey") + 1).alias("cluster")), "place", "entity", {"e7": "s7"})
    kept = geo.in_box(joined, (76, 85.5), (23.5, 31.5), "place", (("e50", F.col("lat") > 27), ("e60", F.col("lon") < 77)))
    return rounded(kept.select("place", "cluster", "lon", "lat"))


@query("SELECT c_nationkey::BIGINT AS cluster, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) < 60")
def small_clusters(spark, sf):
    return rounded(cluster.small_clusters(table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster")), 60))


@query("""WITH e AS (SELECT unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings), s AS (SELECT 'f' || i AS feature, avg(x::DOUBLE) AS mean, stddev_pop(x::DOUBLE) AS deviation FROM e GROUP BY i)
SELECT feature, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM s""")
def feature_scales(spark, sf):
    e = table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)])
    return rounded(cluster.scaler_table(e, [f"f{i}" for i in range(64)]))
