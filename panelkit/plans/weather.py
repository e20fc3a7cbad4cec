"""Weather: daily to monthly and yearly panels, and 116 features of an entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import stats
from ..operators import series

RAINY, HEAVY, VERY_HEAVY = 2.5, 64.5, 115.6
HDD_BASES = (10, 15, 18)
#: The base whose variation stands for all in the stability features.
PRIMARY_HDD = 18
WINTER, SUMMER, MONSOON = (12, 1, 2), (3, 4, 5), (6, 7, 8, 9)
NON_MONSOON = (10, 11, 12, 1, 2, 3, 4, 5)
RABI = (10, 11, 12, 1, 2, 3)


def _hdd(base: int) -> Column:
    return F.coalesce(F.sum(F.greatest(F.lit(0.0), base - F.col("tmean"))), F.lit(0.0)).alias(f"HDD_{base}")


def daily_weather(tmax: DataFrame, tmin: DataFrame, rain: DataFrame, entity: str) -> DataFrame:
    """entity, date, year, month, day, tmax, tmin, tmean, rainfall of the days that all three series have.

    The series (entity, date, value; one row a day) are stacked and grouped once instead of joined twice. Negative rain
    is an artefact of interpolation and counts as none.
    """
    kinds = {"tmax": tmax, "tmin": tmin, "rainfall": rain}
    stacked = reduce(DataFrame.unionByName, [df.select(entity, "date", F.lit(k).alias("kind"), F.lit(1 << i).alias("bit"), "value") for i, (k, df) in enumerate(kinds.items())])
    days = stacked.groupBy(entity, "date").agg(F.bit_or("bit").alias("_kinds"), *[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in kinds])
    mean, rainfall = (F.col("tmax") + F.col("tmin")) / 2, F.when(F.col("rainfall") < 0, 0.0).otherwise(F.col("rainfall"))
    return days.where(F.col("_kinds") == 7).select(entity, "date", F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"), "tmax", "tmin", mean.alias("tmean"), rainfall.alias("rainfall"))


def monthly_weather(daily: DataFrame, entity: str) -> DataFrame:
    """Means of the temperatures, rain, rainy days and degree days of each month: one grouping."""
    return daily.groupBy(entity, "year", "month").agg(
        F.avg("tmax").alias("avg_tmax"),
        F.avg("tmin").alias("avg_tmin"),
        F.avg("tmean").alias("avg_tmean"),
        F.coalesce(F.sum("rainfall"), F.lit(0.0)).alias("monthly_rainfall"),
        F.count_if(F.col("rainfall") >= RAINY).cast("int").alias("rainy_days"),
        *[_hdd(b) for b in HDD_BASES],
    )


def yearly_weather(daily: DataFrame, monthly: DataFrame, entity: str) -> DataFrame:
    """Yearly means, extremes, rain and counts of days; degree days are rolled up from the months."""
    days = daily.groupBy(entity, "year").agg(
        F.avg("tmax").alias("avg_tmax"),
        F.avg("tmin").alias("avg_tmin"),
        F.avg("tmean").alias("avg_tmean"),
        F.max("tmax").alias("max_tmax"),
        F.min("tmin").alias("min_tmin"),
        F.coalesce(F.sum("rainfall"), F.lit(0.0)).alias("annual_rainfall"),
        F.count_if(F.col("rainfall") >= RAINY).cast("int").alias("rainy_days"),
        F.count_if(F.col("rainfall") >= HEAVY).cast("int").alias("heavy_rain_days"),
        F.count_if(F.col("rainfall") >= VERY_HEAVY).cast("int").alias("very_heavy_rain_days"),
    )
    degrees = monthly.groupBy(entity, "year").agg(*[F.sum(f"HDD_{b}").alias(f"HDD_{b}") for b in HDD_BASES])
    return days.join(degrees, [entity, "year"])


def _within(months: tuple[int, ...], c: str) -> Column:
    return F.when(F.col("month").isin(*months), F.col(c))


def _placed(yearly: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """yearly with _i_<c>: the place (from 0) of a row among those of its entity that have a value in c."""
    w = Window.partitionBy(entity).orderBy("year")
    return yearly.withColumns({f"_i_{c}": F.when(F.col(c).isNotNull(), F.count(c).over(w) - 1) for c in columns})


def _ends(c: str) -> Column:
    return stats.growth(F.min_by(c, "year"), F.max_by(c, "year"), F.count("*") - 1)


def temperature_features(yearly: DataFrame, monthly: DataFrame, entity: str) -> DataFrame:
    y = _placed(yearly, entity, ["avg_tmean"])
    every = ("tmax", "tmin", "tmean")
    by_year = y.groupBy(entity).agg(
        *[f(f"avg_{c}").alias(f"temperature_{n}_{c}") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp)) for c in every],
        *[stats.cv(F.col(f"avg_{c}")).alias(f"temperature_cv_{c}") for c in every],
        F.max("max_tmax").alias("temperature_max_tmax"),
        F.min("min_tmin").alias("temperature_min_tmin"),
        F.max("avg_tmean").alias("temperature_max_tmean"),
        F.min("avg_tmean").alias("temperature_min_tmean"),
        stats.slope(F.col("avg_tmean"), F.col("_i_avg_tmean"), 3).alias("temperature_trend"),
        _ends("avg_tmean").alias("temperature_cagr"),
    )
    by_month = monthly.groupBy(entity).agg(
        F.avg(F.col("avg_tmax") - F.col("avg_tmin")).alias("temperature_avg_diurnal_range"),
        *[F.avg(_within(m, "avg_tmean")).alias(f"temperature_mean_{n}") for n, m in (("winter", WINTER), ("summer", SUMMER))],
        *[stats.cv(_within(m, "avg_tmean")).alias(f"temperature_cv_{n}") for n, m in (("winter", WINTER), ("summer", SUMMER))],
    )
    by_month = by_month.withColumn("temperature_summer_winter_diff", F.col("temperature_mean_summer") - F.col("temperature_mean_winter"))
    return by_year.join(by_month, entity)


def rainfall_features(yearly: DataFrame, monthly: DataFrame, daily: DataFrame, entity: str) -> DataFrame:
    """The anomaly index is a mean of deviations from the mean: exactly 0 by definition here."""
    y = _placed(yearly, entity, ["annual_rainfall"])
    r = F.col("annual_rainfall")
    positive_cv = lambda c: F.when(F.avg(c) > 0, stats.cv(F.col(c)))
    by_year = y.groupBy(entity).agg(
        F.avg(r).alias("rainfall_mean_annual"),
        F.median(r).alias("rainfall_median_annual"),
        F.stddev_samp(r).alias("rainfall_std_annual"),
        positive_cv("annual_rainfall").alias("rainfall_cv_annual"),
        F.max(r).alias("rainfall_max_annual"),
        F.avg("rainy_days").alias("rainfall_avg_rainy_days"),
        stats.slope(r, F.col("_i_annual_rainfall"), 3).alias("rainfall_trend"),
        _ends("annual_rainfall").alias("rainfall_cagr"),
        F.lit(0.0).alias("rainfall_anomaly_index"),
    )
    by_month = monthly.groupBy(entity).agg(
        F.avg("monthly_rainfall").alias("rainfall_mean_monthly"),
        F.stddev_samp("monthly_rainfall").alias("rainfall_std_monthly"),
        positive_cv("monthly_rainfall").alias("rainfall_cv_monthly"),
        F.max("monthly_rainfall").alias("rainfall_max_monthly"),
        F.min("monthly_rainfall").alias("rainfall_min_monthly"),
    )
    shares = monthly.groupBy(entity, "year").agg(F.sum(_within(MONSOON, "monthly_rainfall")).alias("m"), F.sum(_within(NON_MONSOON, "monthly_rainfall")).alias("o"))
    by_season = shares.groupBy(entity).agg(F.avg("m").alias("rainfall_mean_monsoon"), F.avg("o").alias("rainfall_mean_non_monsoon"), positive_cv("m").alias("rainfall_monsoon_cv"))
    climate = monthly.groupBy(entity, "month").agg(F.avg("monthly_rainfall").alias("p"))
    by_climate = climate.groupBy(entity).agg(F.max_by("month", F.struct("p", -F.col("month"))).alias("rainfall_peak_month"), stats.concentration(F.col("p")).alias("rainfall_concentration_index"))
    w = series.by_time(entity, "date")
    dry = daily.withColumn("t", F.row_number().over(w)).withColumn("dry", series.streak(F.col("rainfall") < RAINY, w, F.col("t")))
    share = lambda mm: F.count_if(F.col("rainfall") >= mm) / F.count("*")
    by_day = dry.groupBy(entity).agg(
        share(RAINY).alias("rainfall_wet_day_frequency"),
        share(HEAVY).alias("rainfall_heavy_rain_frequency"),
        share(VERY_HEAVY).alias("rainfall_very_heavy_frequency"),
        F.max("dry").cast("int").alias("rainfall_longest_dry_spell"),
    )
    out = by_year.join(by_month, entity).join(by_season, entity).join(by_climate, entity).join(by_day, entity)
    return out.withColumn("rainfall_monsoon_share", F.when(F.col("rainfall_mean_annual") > 0, F.col("rainfall_mean_monsoon") / F.col("rainfall_mean_annual")))


def hdd_features(yearly: DataFrame, monthly: DataFrame, entity: str) -> DataFrame:
    """14 features for each base; hdd<base>_anomaly is exactly 0 by definition here."""
    names = [f"HDD_{b}" for b in HDD_BASES]
    w, all_years = series.by_time(entity, "year"), Window.partitionBy(entity)
    y = _placed(yearly, entity, names).withColumn("t", F.row_number().over(w))
    y = y.withColumns({f"_m_{c}": F.avg(c).over(all_years) for c in names})
    y = y.withColumns({f"_s_{c}": series.streak(F.col(c) > F.col(f"_m_{c}"), w, F.col("t")) for c in names})
    by_year, by_month = [], []
    for b, c in zip(HDD_BASES, names):
        x, p = F.col(c), f"hdd{b}_"
        variation = F.when(F.avg(x) > 0, stats.cv(x))
        total = F.sum(x)
        by_year += [
            F.avg(x).alias(p + "mean"),
            F.median(x).alias(p + "median"),
            F.stddev_samp(x).alias(p + "std"),
            variation.alias(p + "cv"),
            F.max(x).alias(p + "max"),
            F.min(x).alias(p + "min"),
            (F.count_if(x > 0) / F.count("*")).alias(p + "nonzero_freq"),
            (F.count_if(x > F.col(f"_m_{c}")) / F.count("*")).alias(p + "high_freq"),
            stats.slope(x, F.col(f"_i_{c}"), 3).alias(p + "trend"),
            variation.alias(p + "variability_index"),
            F.max(f"_s_{c}").cast("int").alias(p + "persistence"),
            F.lit(0.0).alias(p + "anomaly"),
        ]
        by_month += [F.when(total > 0, F.coalesce(F.sum(_within(m, c)), F.lit(0.0)) / total).alias(f"{p}{n}_share") for n, m in (("winter", WINTER), ("summer", SUMMER))]
    return y.groupBy(entity).agg(*by_year).join(monthly.groupBy(entity).agg(*by_month), entity)


def spi_features(spi: DataFrame, entity: str) -> DataFrame:
    """Of SPI1. Frequencies are among months that have a score; a missing one ends a spell."""
    w = series.by_time(entity, "year", "month")
    s = F.col("SPI1")
    p = spi.withColumn("t", F.row_number().over(w))
    p = p.withColumns({"_d": series.streak(s < -1.0, w, F.col("t")), "_w": series.streak(s > 1.0, w, F.col("t"))})
    share = lambda holds: F.avg(F.when(s.isNotNull(), holds.cast("int")))
    return p.groupBy(entity).agg(
        F.avg(s).alias("spi1_mean"),
        F.median(s).alias("spi1_median"),
        F.stddev_samp(s).alias("spi1_std"),
        share((s > -1.0) & (s <= -0.5)).alias("spi1_mild_drought_freq"),
        share((s > -1.5) & (s <= -1.0)).alias("spi1_moderate_drought_freq"),
        share(s <= -1.5).alias("spi1_severe_drought_freq"),
        share(s > 1.0).alias("spi1_wet_freq"),
        F.max("_d").cast("int").alias("spi1_longest_drought_spell"),
        F.max("_w").cast("int").alias("spi1_longest_wet_spell"),
        series.mean_run(s < -1.0, F.col("_d")).alias("spi1_avg_drought_duration"),
        F.min(s).alias("spi1_min"),
        F.max(s).alias("spi1_max"),
        F.avg(_within(MONSOON, "SPI1")).alias("spi1_mean_monsoon"),
        F.avg(_within(RABI, "SPI1")).alias("spi1_mean_rabi"),
    )


def climate_features(yearly: DataFrame, features: DataFrame, entity: str) -> DataFrame:
    """Stability 1 / (1 + variation), variances, extreme years (first on tie), and the mean variation."""
    extremes = yearly.groupBy(entity).agg(
        F.var_samp("avg_tmean").alias("climate_temp_variance"),
        F.var_samp("annual_rainfall").alias("climate_rain_variance"),
        F.var_samp(f"HDD_{PRIMARY_HDD}").alias("climate_hdd_variance"),
        F.max_by("year", F.struct("avg_tmean", -F.col("year"))).alias("climate_warmest_year"),
        F.min_by("year", F.struct("avg_tmean", "year")).alias("climate_coldest_year"),
        F.max_by("year", F.struct("annual_rainfall", -F.col("year"))).alias("climate_wettest_year"),
        F.min_by("year", F.struct("annual_rainfall", "year")).alias("climate_driest_year"),
    )
    parts = {"temp": "temperature_cv_tmean", "rain": "rainfall_cv_annual", "hdd": f"hdd{PRIMARY_HDD}_cv", "spi": "spi1_std"}
    known = F.array_compact(F.array(*[F.col(c) for c in parts.values()]))
    score = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    varied = features.select(entity, *[(1 / (1 + F.col(c))).alias(f"climate_{n}_stability") for n, c in parts.items()], score.alias("climate_variability_score"))
    return extremes.join(varied, entity)


def weather_features(daily: DataFrame, spi: DataFrame, entity: str) -> DataFrame:
    """One row an entity: 116 features. The panels that all of them read are computed once."""
    monthly = cut(monthly_weather(daily, entity))
    yearly = cut(yearly_weather(daily, monthly, entity))
    four = temperature_features(yearly, monthly, entity)
    for part in (rainfall_features(yearly, monthly, daily, entity), hdd_features(yearly, monthly, entity), spi_features(spi, entity)):
        four = four.join(part, entity, "left")
    return four.join(climate_features(yearly, four, entity), entity, "left")
