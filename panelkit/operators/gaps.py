"""Dense grids and gap filling: calendar grids, month imputation, as-of year filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import in_year
from ..functions.numbers import carried


def month_grid(panel: DataFrame, entity: str, first: int, last: int) -> DataFrame:
    """entity, year, month: every month of first..last for every entity of panel."""
    grid = panel.select(entity).distinct()
    grid = grid.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def year_grid(panel: DataFrame, entity: str, first: int, last: int) -> DataFrame:
    return panel.select(entity).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def fill_months(panel: DataFrame, entity: str, first: int, last: int, values: tuple[str, ...], lead: str, days: str | None = None) -> DataFrame:
    """Dense monthly panel without gaps, and is_imputed.

    lead: the value whose absence makes a month imputed, and a year missing if all its months lack it. A wholly missing
    year takes, month by month, what the last year that is not missing had, and the last year of such a run the mean of
    that and of the next year's month. What is still missing lies on the line between its neighbours in time, or takes
    the nearest value at either end. days: a count that is 0 where there were no rows.

    All windows are of the entity, so one shuffle serves them all.
    """
    grid = month_grid(panel, entity, first, last).join(panel, [entity, "year", "month"], "left")
    grid = grid.withColumn("is_imputed", F.col(lead).isNull().cast("int")).withColumn("_t", (F.col("year") - first) * 12 + F.col("month"))
    grid = grid.repartition(F.col(entity))
    by_year = Window.partitionBy(entity, "year")
    by_month = Window.partitionBy(entity, "month").orderBy("year")
    grid = grid.withColumn("_gone", F.bool_and(F.col(lead).isNull()).over(by_year))
    earlier, later = by_month.rowsBetween(Window.unboundedPreceding, -1), by_month
    for c in values:
        carry = F.last(F.when(~F.col("_gone"), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(earlier)["v"]
        following = F.lead(F.when(~F.col("_gone"), F.col(c))).over(later)
        both = F.coalesce((carry + following) / 2, carry, following, F.col(c))
        grid = grid.withColumn(f"_{c}", F.when(F.col("_gone"), both).otherwise(F.col(c)))
    order = Window.partitionBy(entity).orderBy("_t")
    for c in values:
        point = F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col("_t").alias("t"), F.col(f"_{c}").alias("x")))
        a = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        b = F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
        line = a["x"] + (b["x"] - a["x"]) * F.try_divide((F.col("_t") - a["t"]).cast("double"), (b["t"] - a["t"]).cast("double"))
        grid = grid.withColumn(c, F.coalesce(F.col(f"_{c}"), line, a["x"], b["x"]))
    if days:
        grid = grid.withColumn(days, F.coalesce(days, F.lit(0)))
        grid = grid.withColumn("is_imputed", F.when(F.col(days) == 0, 1).otherwise(F.col("is_imputed")))
    return grid.drop("_t", "_gone", *[f"_{c}" for c in values])


def as_of_year(panel: DataFrame, entity: str, first: int, last: int) -> DataFrame:
    """entity, year, source_year for every year of first..last: itself if present, else the nearest earlier, else the nearest later one."""
    present = panel.where(F.col("year").between(first, last)).select(entity, "year").distinct().withColumn("have", F.col("year"))
    grid = year_grid(present, entity, first, last).join(present, [entity, "year"], "left")
    order = Window.partitionBy(entity).orderBy("year")
    earlier = F.last("have", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("have", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return grid.select(entity, "year", F.coalesce(earlier, later).alias("source_year"))


def fill_years(rows: DataFrame, entity: str, date: str, prices: tuple[str, ...], rates: dict[int, float], first: int, last: int) -> DataFrame:
    """Rows of missing years made from the as-of year's: dates moved, prices carried year by year with rounding.

    imputed_from_year is the year next to it on the way (itself possibly made). 29 February is left out of every made year.
    """
    plan = as_of_year(rows, entity, first, last).where(F.col("year") != F.col("source_year")).withColumnRenamed("year", "year_filled")
    made = rows.join(plan, (rows[entity] == plan[entity]) & (rows["year"] == plan["source_year"])).drop(plan[entity])
    source, target = F.col("source_year").cast("int"), F.col("year_filled").cast("int")
    made = made.withColumns({c: carried(F.col(c), source, target, rates) for c in prices})
    made = made.where(~((F.month(date) == 2) & (F.dayofmonth(date) == 29)))
    made = made.withColumn(date, in_year(F.col(date), target)).withColumn("imputed_from_year", F.when(source < target, target - 1).otherwise(target + 1))
    return made.withColumn("year", target).withColumn("is_imputed", F.lit(True)).drop("year_filled", "source_year")


def fill_log(rows: DataFrame, entity: str, date: str, first: int, last: int) -> DataFrame:
    """entity, year_filled, source_year (next to it), direction, rows_written, rows_dropped_feb29 (counted on the first hop)."""
    plan = as_of_year(rows, entity, first, last).where(F.col("year") != F.col("source_year"))
    leap = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    sizes = rows.groupBy(entity, F.col("year").alias("source_year")).agg(F.count("*").alias("n"), F.count_if(leap).alias("n29"))
    forward = F.col("year") > F.col("source_year")
    hop = F.when(forward, F.col("year") - 1).otherwise(F.col("year") + 1)
    return plan.join(sizes, [entity, "source_year"]).select(
        entity,
        F.col("year").alias("year_filled"),
        hop.alias("source_year"),
        F.when(forward, "forward").otherwise("backward").alias("direction"),
        (F.col("n") - F.col("n29")).alias("rows_written"),
        F.when(hop == F.col("source_year"), F.col("n29")).otherwise(0).alias("rows_dropped_feb29"),
    )
