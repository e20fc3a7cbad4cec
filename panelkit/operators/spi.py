"""Standardised precipitation index: a gamma distribution fitted to each entity's calendar month, mapped to normal scores.

All in column expressions: a month's fit needs the count, the mean and the mean logarithm of its positive totals, which
one grouping gives, combined before its shuffle; scores follow row by row from the fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import gamma_p, gamma_shape, normal_quantile
from . import series

#: Probabilities are kept this far from 0 and 1.
EDGE = 1e-6


def fits(sums: DataFrame, keys: list[str], columns: list[str], least: int = 5) -> DataFrame:
    """keys, and for each column c: shape_c, scale_c (null with fewer than `least` positive values), zeros_c (share of zeros among all rows).

    NaN counts as missing; missing rows count in the share.
    """
    stats, out = [], []
    for c in columns:
        x = F.col(c)
        positive = F.when((x > 0) & ~F.isnan(x), x)
        stats += [F.count(positive).alias(f"n_{c}"), F.avg(positive).alias(f"mean_{c}"), F.avg(F.log(positive)).alias(f"log_{c}"), (F.count_if(x == 0) / F.count("*")).alias(f"zeros_{c}")]
        shape = F.when(F.col(f"n_{c}") >= least, gamma_shape(F.log(f"mean_{c}") - F.col(f"log_{c}")))
        out.append(shape.alias(f"shape_{c}"))
    scales = [(F.col(f"mean_{c}") / F.col(f"shape_{c}")).alias(f"scale_{c}") for c in columns]
    return sums.groupBy(*keys).agg(*stats).select("*", *out).select(*keys, *[f"shape_{c}" for c in columns], *scales, *[f"zeros_{c}" for c in columns])


def scored(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with normal scores. columns: total -> name of its score; shape_, scale_ and zeros_ of each total are there.

    Zeros stand at their share, positive totals beyond it by the gamma distribution; without a fit there is no score. Each
    step is a projection of its own, so that none is worked out once for every place that it is used in.
    """
    scaled = rows.withColumns({f"_x_{c}": F.when(~F.isnan(c), F.col(c) / F.col(f"scale_{c}")) for c in columns})
    held = {c: gamma_p(F.col(f"shape_{c}"), F.col(f"_x_{c}")) for c in columns}
    zeros = {c: F.col(f"zeros_{c}") for c in columns}
    placed = scaled.withColumns({f"_p_{c}": F.when(F.col(f"_x_{c}") <= 0, zeros[c]).otherwise(zeros[c] + (1 - zeros[c]) * held[c]) for c in columns})
    inner = placed.withColumns({f"_q_{c}": F.least(F.greatest(f"_p_{c}", F.lit(EDGE)), F.lit(1 - EDGE)) for c in columns})
    there = lambda c: F.when(F.col(f"shape_{c}").isNotNull() & F.col(f"_x_{c}").isNotNull(), normal_quantile(F.col(f"_q_{c}")))
    return inner.withColumns({name: there(c) for c, name in columns.items()})


def spi(monthly: DataFrame, entity: str, rain: str, scales: tuple[int, ...] = (1, 3)) -> DataFrame:
    """entity, year, month, rain and SPI1, SPI3, ...: the scores of sums over the last months, among the same calendar month's.

    A score is null where a month of its sum is missing, or where fewer than 5 of the calendar month's sums are positive.
    """
    w = series.by_time(entity, "year", "month")
    value = F.col(rain).cast("double")
    sums = monthly.select(entity, "year", "month", F.when(~F.isnan(value), value).alias(rain))
    sums = sums.withColumns({f"_r{s}": series.rolling(F.col(rain), w, s, F.sum) for s in scales})
    columns = [f"_r{s}" for s in scales]
    known = sums.join(fits(sums, [entity, "month"], columns), [entity, "month"], "left")
    return scored(known, {c: f"SPI{s}" for s, c in zip(scales, columns)}).select(entity, "year", "month", rain, *[f"SPI{s}" for s in scales])
