"""Numbers out of text, rounding, and folds over yearly rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Number of a text with thousands commas; null (never NaN) if it is none."""
    number = F.regexp_replace(F.trim(text.cast("string")), ",", "").try_cast("double")
    return F.when(~F.isnan(number), number)


def midpoint(a: Column, b: Column) -> Column:
    """Middle of two prices, rounded half to even to a whole."""
    return F.bround((a + b) / 2, 0)


def rates_map(rates: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for year, rate in sorted(rates.items()) for x in (year, float(rate))])


def carried(price: Column, source: Column, target: Column, rates: dict[int, float], decimals: int = 2) -> Column:
    """price of the source year in the target year: each year between multiplies (or, back in time, divides) by 1 + rate and rounds."""
    rate = rates_map(rates)
    forward = F.aggregate(F.when(target > source, F.sequence(source + 1, target)).otherwise(F.array().cast("array<int>")), price, lambda a, y: F.bround(a * (1 + F.element_at(rate, y)), decimals))
    back = F.aggregate(F.when(target < source, F.sequence(source, target + 1, F.lit(-1))).otherwise(F.array().cast("array<int>")), price, lambda a, y: F.bround(a / (1 + F.element_at(rate, y)), decimals))
    return F.when(target > source, forward).when(target < source, back).otherwise(price)


def carry_factor(source: Column, target: Column, rates: dict[int, float]) -> Column:
    """The factor of carried() without rounding."""
    rate = rates_map(rates)
    low, high = F.least(source, target), F.greatest(source, target)
    up = F.aggregate(F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, y: a * (1 + F.element_at(rate, y)))
    return F.when(target >= source, up).otherwise(1 / up)
