"""Window operators on an entity's ordered series. Each adds columns; all use the one window (entity; order)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time(entity: str, *order: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(*order)


def difference(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def change(x: Column, w: WindowSpec) -> Column:
    """Relative change; null after 0."""
    return F.try_divide(x, F.lag(x).over(w)) - 1


def rolling(x: Column, w: WindowSpec, n: int, f) -> Column:
    """f over the last n rows; null unless all n have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, f(x).over(frame))


def rolling_median(x: Column, w: WindowSpec, n: int, least: int) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= least, F.percentile(x, F.lit(0.5)).over(frame))


def drawdown(x: Column, w: WindowSpec) -> Column:
    """Fall below the highest value so far, as a fraction (0 or negative)."""
    top = F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(x - top, top)


def streak(holds: Column, w: WindowSpec, place: Column) -> Column:
    """Rows in a row, this one included, for which the predicate holds (null counts as not). place: row number in w.

    Its maximum is the longest run: no second grouping is needed.
    """
    yes = F.coalesce(holds, F.lit(False))
    broken = F.last(F.when(~yes, place), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(yes, place - F.coalesce(broken, F.lit(0))).otherwise(0)


def mean_run(holds: Column, streaks: Column) -> Column:
    """Mean length of runs (aggregate); 0 if there is none."""
    return F.coalesce(F.try_divide(F.count_if(holds).cast("double"), F.count_if(streaks == 1)), F.lit(0.0))


def turning(diff: Column, w: WindowSpec) -> Column:
    """1 where the sign of a non-zero difference is not that of the last non-zero one."""
    sign = F.when(diff != 0, F.signum(diff))
    before = F.last(sign, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce((sign != before).cast("int"), F.lit(0))


def standardised(x: Column, everything: WindowSpec) -> Column:
    """(x - mean) / deviation of the entity; 0 where there is no deviation."""
    sd = F.stddev_samp(x).over(everything)
    return F.when(sd > 0, (x - F.avg(x).over(everything)) / sd).otherwise(0.0)


def level_shift(z: Column, w: WindowSpec, place: Column, n: Column, width: int = 6, least: float = 1.5) -> Column:
    """1 where the mean of the next `width` values (this one included) is over `least` away from that of the last `width`."""
    after, before = F.avg(z).over(w.rowsBetween(0, width - 1)), F.avg(z).over(w.rowsBetween(-width, -1))
    return F.when((place > width) & (place <= n - width), (F.abs(after - before) > least).cast("int")).otherwise(0)


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates)
