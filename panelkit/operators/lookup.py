"""Key sets, anti and semi joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def outstanding(requests: DataFrame, done: DataFrame, empty: DataFrame, unit: list[str], part: str) -> DataFrame:
    """Requests neither done nor known to be empty, but for units whose every part is known empty."""
    known = requests.join(empty.select(*unit, part).distinct().withColumn("_e", F.lit(True)), [*unit, part], "left")
    all_empty = known.groupBy(*unit).agg(F.bool_and(F.coalesce("_e", F.lit(False))).alias("_all")).where("_all").select(*unit)
    left = requests.join(done.select(*unit, part), [*unit, part], "left_anti").join(empty.select(*unit, part), [*unit, part], "left_anti")
    return left.join(all_empty, unit, "left_anti")
