"""Checks of a finished panel, each a count of what breaks the rule: one grouping by unit, one over all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def panel_checks(panel: DataFrame, entity: str, prices: tuple[str, ...], reports: str = "reporting_days", imputed: str = "is_imputed") -> DataFrame:
    """check, n of an (entity, year, month) panel: n = 0 if it passes.

    years without exactly 12 different months; repeated months (all but the first row of each); missing and negative
    prices; negative report counts; rows without reports that are not marked as imputed.
    """
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    each: dict[str, Column] = {
        "missing_prices": total([F.count_if(F.col(c).isNull()) for c in prices]),
        "negative_prices": total([F.count_if(F.col(c) < 0) for c in prices]),
        "negative_reports": F.count_if(F.col(reports) < 0),
        "unmarked_imputations": F.count_if((F.col(reports) == 0) & ~F.col(imputed).eqNullSafe(1)),
    }
    months = panel.groupBy(entity, "year", "month").agg(F.count("*").alias("_n"), *[c.alias(k) for k, c in each.items()])
    years = months.groupBy(entity, "year").agg(F.count("*").alias("_m"), F.sum(F.col("_n") - 1).alias("repeated_months"), *[F.sum(k).alias(k) for k in each])
    names = ["repeated_months", *each]
    whole = years.agg(F.count_if(F.col("_m") != 12).alias("incomplete_years"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names])
    return whole.unpivot([], ["incomplete_years", *names], "check", "n")


def out_of_order(rows: DataFrame, entity: str, place: str, time: Column) -> DataFrame:
    """entity, n: rows whose time lies before that of the row which stands before them (by the column `place`)."""
    w = Window.partitionBy(entity).orderBy(place)
    return rows.withColumn("_t", time).withColumn("_b", F.lag("_t").over(w)).groupBy(entity).agg(F.count_if(F.col("_t") < F.col("_b")).alias("n"))
