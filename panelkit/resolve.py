"""Which column is which: resolvers on the names of a header (and one on its values)."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical name -> names under which files have it, in order of preference.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "date": ("price date", "date", "arrival date", "reported date"),
    "market_id": ("market id", "marketid"),
    "min_price": ("min price", "minimum price"),
    "max_price": ("max price", "maximum price"),
    "modal_price": ("modal price", "mode price"),
}


def normalized(name: str) -> str:
    """Lower case, "_x0020_" and "_" as spaces, spaces collapsed."""
    return re.sub(r"\s+", " ", name.lower().replace("_x0020_", " ").replace("_", " ")).strip()


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """First candidate that some name equals, then first name that holds some candidate."""
    names = {c: normalized(c) for c in columns}
    for wanted in candidates:
        for c, n in names.items():
            if n == wanted:
                return c
    return next((c for c, n in names.items() if any(wanted in n for wanted in candidates)), None)


def detect_column(columns: list[str], patterns: tuple[str, ...]) -> str | None:
    """First pattern, in order, that some lower-cased name holds."""
    return next((c for p in patterns for c in columns if p in c.lower()), None)


def column_place(columns: Column, candidates: tuple[str, ...]) -> Column:
    """find_column() on an array of names, for tables of headers: the place from 0, or null."""
    spaced = lambda c: F.replace(F.replace(F.lower(c), F.lit("_x0020_"), F.lit(" ")), F.lit("_"), F.lit(" "))
    names = F.transform(columns, lambda c: F.trim(F.regexp_replace(spaced(c), r"\s+", " ")))
    equal = [F.nullif(F.array_position(names, wanted), F.lit(0)) for wanted in candidates]
    holding = F.transform(names, lambda n: reduce(lambda a, b: a | b, [F.contains(n, F.lit(wanted)) for wanted in candidates]))
    return (F.coalesce(*equal, F.nullif(F.array_position(holding, True), F.lit(0))) - 1).cast("int")


def pattern_place(columns: Column, patterns: tuple[str, ...]) -> Column:
    """detect_column() on an array of names: the place from 0, or null."""
    places = [F.nullif(F.array_position(F.transform(columns, lambda c: F.contains(F.lower(c), F.lit(p))), True), F.lit(0)) for p in patterns]
    return (F.coalesce(*places) - 1).cast("int")


def canonical_names(columns: list[str]) -> dict[str, str]:
    """canonical name -> column, by equality with a known variant (or the canonical name itself) only."""
    found: dict[str, str] = {}
    for key, variants in CANDIDATES.items():
        wanted = {normalized(key), *variants}
        column = next((c for c in columns if normalized(c) in wanted), None)
        if column is not None:
            found[key] = column
    return found


def require(columns: list[str], wanted: tuple[str, ...]) -> None:
    missing = [c for c in wanted if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def column_by_content(df: DataFrame, text: str) -> str | None:
    """First text column of which some value holds the given text, whatever its case: one pass over the table."""
    names = [c for c, k in df.dtypes if k == "string"]
    if not names:
        return None
    row = df.agg(*[F.max(F.contains(F.lower(F.col(c)), F.lit(text.lower())).cast("int")).alias(c) for c in names]).first()
    return next((c for c in names if row[c]), None)


def identifier_column(df: DataFrame, longer_than: float = 3) -> str | None:
    """First text column without repeats or nulls whose values are longer than that on average."""
    names = [c for c, k in df.dtypes if k == "string"]
    if not names:
        return None
    row = df.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(f"d_{c}") for c in names], *[F.avg(F.length(c)).alias(f"l_{c}") for c in names]).first()
    return next((c for c in names if row[f"d_{c}"] == row["_n"] and (row[f"l_{c}"] or 0) > longer_than), None)
