"""Price features of an entity: 64 columns from its dense monthly panel, in one pass of windows and two groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import series

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def monthly_panel(daily: DataFrame, entity: str) -> DataFrame:
    """entity, year, month: means of modal, min, max and spread, and the number of days with prices."""
    return daily.groupBy(entity, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.avg("modal_price").alias("mean_modal_price"),
        F.avg("min_price").alias("mean_min_price"),
        F.avg("max_price").alias("mean_max_price"),
        F.avg(F.col("max_price") - F.col("min_price")).alias("mean_price_spread"),
        F.count_distinct("date").cast("int").alias("reporting_days"),
    )


def with_series(panel: DataFrame, entity: str, value: str) -> DataFrame:
    """panel with place t (from 1) and the series columns: diff, ret, vol3, vol6, fall, up, down, turn, shift."""
    w, all_rows = series.by_time(entity, "year", "month"), Window.partitionBy(entity)
    x = F.col(value)
    p = panel.repartition(F.col(entity)).withColumns({"t": F.row_number().over(w), "n": F.count(F.lit(1)).over(all_rows), "z": series.standardised(x, all_rows)})
    p = p.withColumns({"diff": series.difference(x, w), "ret": series.change(x, w), "vol3": series.rolling(x, w, 3, F.stddev_samp), "vol6": series.rolling(x, w, 6, F.stddev_samp), "fall": series.drawdown(x, w), "shift": series.level_shift(F.col("z"), w, F.col("t"), F.col("n"))})
    return p.withColumns({"up": series.streak(F.col("diff") > 0, w, F.col("t")), "down": series.streak(F.col("diff") < 0, w, F.col("t")), "turn": series.turning(F.col("diff"), w)})


def month_columns(value: str) -> list[Column]:
    """Aggregates: mean and deviation of the value in each calendar month (24)."""
    of = lambda m: F.when(F.col("month") == m, F.col(value))
    return [F.avg(of(i + 1)).alias(f"{m}_avg_price") for i, m in enumerate(MONTHS)] + [F.stddev_samp(of(i + 1)).alias(f"{m}_std_price") for i, m in enumerate(MONTHS)]


def with_season(wide: DataFrame) -> DataFrame:
    """wide with what its twelve monthly means say: amplitude, cv (%), variance, peak to trough, and both months (first on tie)."""
    known = F.array_compact(F.array(*[F.when(F.col(f"{m}_avg_price").isNotNull(), F.struct(F.col(f"{m}_avg_price").alias("x"), F.lit(i + 1).alias("m"))) for i, m in enumerate(MONTHS)]))
    w = wide.withColumn("_k", known).withColumn("_x", F.transform("_k", lambda p: p["x"]))
    total = lambda f: F.aggregate("_x", F.lit(0.0), lambda a, x: a + f(x))
    w = w.withColumn("_mean", F.try_divide(total(lambda x: x), F.size("_x")))
    w = w.withColumn("_month_var", F.try_divide(total(lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))), F.size("_x") - 1))
    low, high = F.array_min("_x"), F.array_max("_x")
    at = lambda x: F.get(F.filter("_k", lambda p: p["x"] == x), 0)["m"]
    return w.withColumns(
        {
            "seasonal_amplitude": high - low,
            "seasonal_cv": stats.ratio(F.sqrt("_month_var"), F.col("_mean")) * 100,
            "peak_to_trough_ratio": stats.ratio(high, low),
            "peak_price_month": at(high),
            "trough_price_month": at(low),
        }
    ).drop("_k", "_x", "_mean")


def seasonal(panel: DataFrame, entity: str, value: str) -> DataFrame:
    """Calendar-month means and deviations (24 columns) and what they say, from one grouping."""
    return with_season(panel.groupBy(entity).agg(*month_columns(value)))


def yearly(panel: DataFrame, entity: str, value: str) -> DataFrame:
    """Per entity and year: mean, peak month, whether all or any months are imputed."""
    return panel.groupBy(entity, "year").agg(
        F.avg(value).alias("avg"),
        F.max_by("month", F.struct(value, -F.col("month"))).alias("peak"),
        F.bool_and(F.col("is_imputed") == 1).alias("all_imputed"),
        F.bool_or(F.col("is_imputed") == 1).alias("any_imputed"),
    )


def price_features(panel: DataFrame, entity: str) -> DataFrame:
    """One row an entity: 64 price features."""
    v, x = "mean_modal_price", F.col("mean_modal_price")
    s = with_series(panel, entity, v)
    u = F.col("t") - (F.col("n") + 1) / 2
    seen = F.when(F.col("is_imputed") == 0, F.col("t"))
    edges = Window.partitionBy(entity)
    s = s.withColumns({"_first": F.min(seen).over(edges), "_last": F.max(seen).over(edges)})
    outside = (F.col("is_imputed") == 1) & F.coalesce((F.col("t") < F.col("_first")) | (F.col("t") > F.col("_last")), F.lit(True))
    level = s.groupBy(entity).agg(
        F.avg(v).alias("price_mean_modal"),
        F.median(v).alias("price_median_modal"),
        F.avg("mean_min_price").alias("price_mean_min"),
        F.avg("mean_max_price").alias("price_mean_max"),
        F.avg("mean_price_spread").alias("price_mean_spread"),
        F.stddev_samp(v).alias("price_std"),
        stats.cv(x, percent=True).alias("price_cv"),
        stats.iqr(x).alias("price_iqr"),
        F.max(v).alias("price_max_monthly"),
        F.min(v).alias("price_min_monthly"),
        F.avg("vol3").alias("price_rolling_vol_3m"),
        F.avg("vol6").alias("price_rolling_vol_6m"),
        F.max(F.abs("diff")).alias("price_max_monthly_change"),
        F.avg(F.abs("diff")).alias("price_mean_abs_monthly_change"),
        F.var_samp(v).alias("_var"),
        stats.slope(x, F.col("t")).alias("price_trend_linear_slope"),
        stats.quadratic(x, u).alias("price_trend_quadratic_coef"),
        stats.ordered(F.col("t"), x).alias("_o"),
        F.sum("shift").cast("int").alias("structural_break_count"),
        F.avg("ret").alias("monthly_return_mean"),
        F.median("ret").alias("monthly_return_median"),
        F.stddev_samp("ret").alias("monthly_return_volatility"),
        (F.avg((F.col("ret") > 0).cast("int")) * 100).alias("pct_positive_months"),
        F.max("up").cast("int").alias("longest_increasing_streak"),
        F.max("down").cast("int").alias("longest_decreasing_streak"),
        F.sum("turn").cast("int").alias("num_turning_points"),
        (-F.min("fall") * 100).alias("max_drawdown"),
        (F.avg("is_imputed") * 100).alias("pct_imputed"),
        (F.avg(outside.cast("int")) * 100).alias("fraction_extrapolated"),
        *month_columns(v),
    )
    level = with_season(level).withColumns({"mann_kendall_tau": stats.kendall_tau(F.col("_o")), "mann_kendall_pvalue": stats.two_sided_p(stats.kendall_z(F.col("_o")))}).drop("_o")
    by_year = yearly(panel, entity, v).groupBy(entity).agg(
        F.when(F.count("*") > 1, stats.growth(F.min_by("avg", "year"), F.max_by("avg", "year"), (F.count("*") - 1))).alias("price_cagr"),
        F.collect_list("peak").alias("_peaks"),
        F.count_if(~F.col("all_imputed")).cast("int").alias("observed_years"),
        F.count_if("any_imputed").cast("int").alias("imputed_years"),
        F.count_if("all_imputed").cast("int").alias("missing_years_before_imputation"),
    )
    out = level.join(by_year, entity)
    same = F.size(F.filter("_peaks", lambda p: p == F.col("peak_price_month")))
    out = out.withColumns({"seasonal_strength": stats.ratio(F.col("_month_var"), F.col("_var")), "peak_month_consistency": F.try_divide(same, F.size("_peaks")) * 100})
    return out.drop("_month_var", "_var", "_peaks")
