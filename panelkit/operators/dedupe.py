"""Duplicate keys: masks, classes of disagreement, and resolution to one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicated(keys: list[str]) -> Column:
    """True for every row whose key occurs more than once (null keys form a group of their own)."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def repeats(keys: list[str], order: list[str]) -> Column:
    """True for all but the first row of each key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def without_zero_prices(rows: DataFrame, low: str, high: str, strict: bool = False) -> DataFrame:
    """Rows but those whose lowest or highest price is 0; prices that are missing stay, unless strict."""
    if strict:
        return rows.where((F.col(low) != 0) & (F.col(high) != 0))  # null compares as unknown, so it goes
    return rows.where(F.coalesce(F.col(low) != 0, F.lit(True)) & F.coalesce(F.col(high) != 0, F.lit(True)))


def _present(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))


def classify(rows: DataFrame, keys: list[str], prices: list[str]) -> DataFrame:
    """One row a duplicated key: rows and type.

    exact: all rows agree in every column; missing value: prices differ only in being absent; price conflict: some
    price has two values; mixed: anything else. Tested in that order.
    """
    every = [c for c in rows.columns if c not in keys]
    one = rows.withColumn("_n", _present(prices))
    grouped = one.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in every])).alias("_d"),
        F.min("_n").alias("_low"),
        F.max("_n").alias("_high"),
        *[F.count_distinct(p).alias(f"_p{i}") for i, p in enumerate(prices)],
    )
    conflict = F.greatest(F.lit(0), *[F.col(f"_p{i}") for i in range(len(prices))]) > 1
    kind = F.when(F.col("_d") == 1, "exact").when(F.col("_low") != F.col("_high"), "missing value").when(conflict, "price conflict").otherwise("mixed")
    return grouped.where("rows > 1").select(*keys, "rows", kind.alias("type"))


def resolve(rows: DataFrame, keys: list[str], order: str, low: str, high: str, modal: str) -> DataFrame:
    """One row a key, and how: single, exact, fullest (most values, first on tie) or merged.

    merged takes the first row with the least low, the greatest high, and as modal their midpoint rounded half to even.
    order: the rows' position in their source. One grouping; hot keys are combined before the shuffle.
    """
    every = [c for c in rows.columns if c not in (*keys, order)]
    one = rows.withColumn("_n", _present(every))
    value = F.struct(*every)
    grouped = one.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in every])).alias("_d"),
        F.min("_n").alias("_low"),
        F.max("_n").alias("_high"),
        F.min_by(value, F.col(order)).alias("_first"),
        F.max_by(value, F.struct("_n", -F.col(order))).alias("_full"),
        F.min(low).alias("_min"),
        F.max(high).alias("_max"),
    )
    how = F.when(F.col("rows") == 1, "single").when(F.col("_d") == 1, "exact").when(F.col("_low") != F.col("_high"), "fullest").otherwise("merged")
    g = grouped.withColumn("how", how)
    base = F.when(F.col("how") == "fullest", F.col("_full")).otherwise(F.col("_first"))
    merged = {low: F.col("_min"), high: F.col("_max"), modal: F.bround((F.col("_min") + F.col("_max")) / 2, 0)}
    return g.select(*keys, *[F.when(F.col("how") == "merged", merged[c]).otherwise(base[c]).alias(c) if c in merged else base[c].alias(c) for c in every], "rows", "how")
