"""Dates and years out of text: parsing, format sniffing, re-dating, crop years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date patterns with the texts they fit, tried in this order.
DATE_FORMATS: tuple[tuple[str, str], ...] = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("dd MMM yyyy", r"^\d{2} [A-Za-z]{3} \d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)


def year_in_name(name: Column) -> Column:
    """First four-digit year of the 1900s or 2000s in a file's name, else null."""
    found = F.regexp_extract(name, r"((?:19|20)\d{2})", 1)
    return F.when(found != "", found.cast("int"))


def date_format(text: Column) -> Column:
    """Name of the first pattern that the trimmed text fits and that gives a date, else null."""
    t = F.trim(text)
    return F.coalesce(*[F.when(t.rlike(fits) & F.try_to_timestamp(F.when(t.rlike(fits), t), F.lit(p)).isNotNull(), F.lit(p)) for p, fits in DATE_FORMATS])


def parse_date(text: Column) -> Column:
    """The date, by whichever pattern fits; a zone or time after an ISO date is dropped; null if none does."""
    t = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2})[T ].*$", "$1")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.when(t.rlike(fits), t), F.lit(p))) for p, fits in DATE_FORMATS])


def parse_by_majority(df: DataFrame, group: str, text: str, out: str) -> DataFrame:
    """Adds out: dates read as ISO in groups where over half of the texts begin like an ISO year, else day first."""
    iso = df.groupBy(group).agg((F.avg(F.trim(text).rlike(r"^\d{4}-").cast("int")) > 0.5).alias("_iso"))
    t = F.regexp_replace(F.trim(F.col(text)), r"^(\d{4}-\d{2}-\d{2})[T ].*$", "$1")
    as_iso = F.to_date(F.try_to_timestamp(F.when(t.rlike(DATE_FORMATS[0][1]), t), F.lit("yyyy-MM-dd")))
    day_first = F.coalesce(*[F.to_date(F.try_to_timestamp(F.when(t.rlike(fits), t), F.lit(p))) for p, fits in DATE_FORMATS[1:3]], as_iso)
    return df.join(iso, group).withColumn(out, F.when(F.col("_iso"), as_iso).otherwise(day_first)).drop("_iso")


def in_year(date: Column, year: Column) -> Column:
    """The same day of another year; null for 29 February of a year that has none."""
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%s", year.cast("int"), F.date_format(date, "MM-dd")), F.lit("yyyy-MM-dd")))


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31))) == 366


def crop_year(text: Column) -> Column:
    """"1998-99" -> 1999: the two-digit end is of the 2000s below 50, else of the 1900s; null for other texts."""
    end = F.regexp_extract(F.trim(text), r"^\d{4}-(\d{2})$", 1)
    two = F.when(end != "", end.cast("int"))
    return F.when(two < 50, 2000 + two).otherwise(1900 + two)
