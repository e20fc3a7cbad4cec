"""Audit of price files: every check of one file as conditional aggregates over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_format, parse_date
from ..functions.numbers import to_number
from . import quantiles, series

PRICES = ("min_price", "max_price", "modal_price")
#: Flags by severity.
CRITICAL = ("F1_unreadable", "F2_empty_file", "F3_header_only", "F4_year_mismatch", "C1_missing_cols", "D1_date_unparseable", "D2_invalid_dates", "D3_dates_out_of_range", "D5_duplicate_dates", "P1_non_numeric_prices", "P2_negative_prices", "P5_price_inversion", "P6_modal_out_of_range")
WARNING = ("C2_nonstandard_names", "C3_extra_cols", "D4_mixed_date_formats", "P3_zero_prices", "P4_price_outliers", "K1_suspicious_jumps")


def outlier_bounds(rows: DataFrame, keys: list[str], value: str, factor: float = 3.0, least: int = 4) -> DataFrame:
    """keys, n_outliers: values beyond `factor` interquartile ranges from the quartiles, in groups of `least` or more."""
    fenced = quantiles.of_groups(rows.select(*keys, value), keys, value, {"_a": 0.25, "_b": 0.75})
    far = (F.col(value) < F.col("_a") - factor * (F.col("_b") - F.col("_a"))) | (F.col(value) > F.col("_b") + factor * (F.col("_b") - F.col("_a")))
    return fenced.groupBy(*keys).agg(F.count_if((F.col("_n") >= least) & far).alias("n_outliers"))


def jumps(rows: DataFrame, keys: list[str], order: list[str], value: str, factor: float = 3.0, least: int = 5) -> DataFrame:
    """keys, n_jumps: changes over `factor` times the rolling median (7, at least 3, this one included) of absolute changes."""
    w, all_rows = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    d = rows.where(F.col(value).isNotNull()).withColumn("_d", F.abs(series.difference(F.col(value), w))).withColumn("_n", F.count(F.lit(1)).over(all_rows))
    d = d.withColumn("_m", series.rolling_median(F.col("_d"), w, 7, 3))
    return d.groupBy(*keys).agg(F.count_if((F.col("_n") >= least) & (F.col("_m") > 0) & (F.col("_d") > factor * F.col("_m"))).alias("n_jumps"))


def audit(rows: DataFrame, first: int = 2006, last: int = 2025, key: tuple[str, ...] = ("district", "filename")) -> DataFrame:
    """One row a file of text rows (district, filename, market_id, date, min_price, max_price, modal_price): flags, counts, issue totals.

    filename's year is its first four digits. Files that could not be read have no rows here: see sources.tables.unreadable.
    """
    key = list(key)
    r = rows.withColumns({"_date": parse_date(F.col("date")), "_format": date_format(F.col("date")), "_year": F.regexp_extract("filename", r"^(\d{4})", 1).try_cast("int"), **{f"_{p}": to_number(F.col(p)) for p in PRICES}})
    r = r.withColumn("_twice", F.count(F.lit(1)).over(Window.partitionBy(*key, "date", "market_id")) > 1)
    given = F.col("date").isNotNull() & (F.trim("date") != "")
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    low, high, modal = (F.col(f"_{p}") for p in PRICES)

    def any_price(test) -> Column:
        return series.any_of(*[F.coalesce(test(p), F.lit(False)) for p in PRICES])

    checks = r.groupBy(*key).agg(
        F.count("*").alias("n_rows"),
        (some(F.col("_date").isNotNull()) & ~some(F.year("_date") == F.col("_year")) & F.max("_year").isNotNull()).alias("F4_year_mismatch"),
        (some(given) & ~some(F.col("_date").isNotNull())).alias("D1_date_unparseable"),
        (some(F.col("_date").isNotNull()) & some(given & F.col("_date").isNull())).alias("D2_invalid_dates"),
        F.count_if(given & F.col("_date").isNull()).alias("n_invalid_dates"),
        F.count_if(~F.year("_date").between(first, last)).alias("n_out_of_range_dates"),
        F.array_join(F.array_sort(F.collect_set("_format")), "|").alias("date_formats_detected"),
        F.count_if("_twice").alias("n_duplicate_dates"),
        some(any_price(lambda p: F.col(p).isNotNull() & F.col(f"_{p}").isNull())).alias("P1_non_numeric_prices"),
        some(any_price(lambda p: F.col(f"_{p}") < 0)).alias("P2_negative_prices"),
        some(any_price(lambda p: F.col(f"_{p}") == 0)).alias("P3_zero_prices"),
        F.count_if(low > high).alias("n_price_inversions"),
        F.count_if(series.any_of(F.coalesce(modal < low, F.lit(False)), F.coalesce(modal > high, F.lit(False)))).alias("n_modal_violations"),
    )
    priced = r.select(*key, F.explode(F.array(*[F.struct(F.lit(p).alias("kind"), F.col(f"_{p}").alias("v")) for p in PRICES])).alias("x")).select(*key, "x.*")
    checks = checks.join(outlier_bounds(priced, [*key, "kind"], "v").groupBy(*key).agg(F.sum("n_outliers").alias("n_price_outliers")), key)
    jumped = jumps(r.select(*key, "market_id", "_date", "_modal_price"), [*key, "market_id"], ["_date", "_modal_price"], "_modal_price").groupBy(*key).agg(F.sum("n_jumps").alias("n_suspicious_jumps"))
    checks = checks.join(jumped, key, "left").withColumns({"n_suspicious_jumps": F.coalesce("n_suspicious_jumps", F.lit(0))})
    flags = {
        "D3_dates_out_of_range": F.col("n_out_of_range_dates") > 0,
        "D4_mixed_date_formats": F.contains("date_formats_detected", F.lit("|")),
        "D5_duplicate_dates": F.col("n_duplicate_dates") > 0,
        "P4_price_outliers": F.col("n_price_outliers") > 0,
        "P5_price_inversion": F.col("n_price_inversions") > 0,
        "P6_modal_out_of_range": F.col("n_modal_violations") > 0,
        "K1_suspicious_jumps": F.col("n_suspicious_jumps") > 0,
    }
    return with_totals(checks.withColumns(flags))


def with_totals(audited: DataFrame) -> DataFrame:
    """audited with critical_issues, warning_issues and total_issues of the flags that it has."""
    have = set(audited.columns)
    total = lambda names: sum((F.coalesce(F.col(n), F.lit(False)).cast("int") for n in names if n in have), F.lit(0))
    return audited.withColumns({"critical_issues": total(CRITICAL), "warning_issues": total(WARNING)}).withColumn("total_issues", F.col("critical_issues") + F.col("warning_issues"))


def complete(audited: DataFrame, files: DataFrame, heads: DataFrame) -> DataFrame:
    """One row for every listed file (district, filename, size): the audit of its rows, what its header shows, and, if it
    gave no rows, why; issue totals over all flags.

    heads: district, filename, columns (array of names; null if the file cannot be read). A file without rows is unreadable
    (F1), empty (F2) or has a header only (F3).
    """
    key = ["district", "filename"]
    shown = heads.select(*key, "columns", F.lit(True).alias("_listed")).join(header_table(heads.select("columns").distinct()), "columns", "left")
    out = files.select(*key, "size").join(shown, key, "left").join(audited.drop("critical_issues", "warning_issues", "total_issues"), key, "left")
    silent = F.coalesce("n_rows", F.lit(0)) == 0
    unread = silent & F.col("columns").isNull() & (F.col("size") > 0)
    out = out.withColumns({"F1_unreadable": unread, "F2_empty_file": F.col("size") == 0, "F3_header_only": silent & (F.col("size") > 0) & ~unread})
    return with_totals(out.drop("_listed", "columns"))


def header_table(headers: DataFrame) -> DataFrame:
    """columns -> C1 to C3 of each different header: as many rows as there are layouts of files."""
    spark = headers.sparkSession
    fields = "C1_missing_cols boolean, missing_cols string, C2_nonstandard_names boolean, nonstandard_cols string, C3_extra_cols boolean, extra_cols string"
    found = [(list(r["columns"]), *header_flags(list(r["columns"])).values()) for r in headers.where("columns is not null").distinct().collect()]
    return spark.createDataFrame(found, f"columns array<string>, {fields}")


def column_variants(heads: DataFrame) -> DataFrame:
    """column_as_found, maps_to_canonical (UNKNOWN if none), file_count over all files' headers (column `columns`)."""
    from ..resolve import canonical_names

    counted = heads.select(F.explode("columns").alias("column_as_found")).groupBy("column_as_found").agg(F.count("*").alias("file_count"))
    canonical = {c: next(iter(canonical_names([c])), "UNKNOWN") for c in (r[0] for r in counted.select("column_as_found").collect())}  # one a spelling
    names = heads.sparkSession.createDataFrame(list(canonical.items()), "column_as_found string, maps_to_canonical string")
    return counted.join(names, "column_as_found").select("column_as_found", "maps_to_canonical", "file_count")


def worst_files(audited: DataFrame, k: int = 20) -> DataFrame:
    """The k files with most critical, then warning issues (ties by name), of those that have any."""
    some = audited.where((F.col("critical_issues") > 0) | (F.col("warning_issues") > 0))
    return some.orderBy(F.desc("critical_issues"), F.desc("warning_issues"), "district", "filename").limit(k).select("district", "filename", "total_issues")


def worst_entities(audited: DataFrame, k: int = 15) -> DataFrame:
    """The k districts with most issues in all (ties by name)."""
    return audited.groupBy("district").agg(F.sum("total_issues").alias("total_issues")).orderBy(F.desc("total_issues"), "district").limit(k)


def report(audited: DataFrame) -> str:
    """The audit as text: files by flag, the worst files and districts (as many lines as these lists have)."""
    flags = sorted(summary(audited).collect(), key=lambda r: r["flag"])
    lines = [f"Files audited: {audited.count()}", "", "Files by flag", *[f"  {r['flag']:30s} {r['files']:6d}" for r in flags], "", "Worst files"]
    lines += [f"  {r['district']:30s} {r['filename']:12s} {r['total_issues']} issue(s)" for r in worst_files(audited).collect()]
    return "\n".join([*lines, "", "Districts with most issues", *[f"  {r['district']:35s} {r['total_issues']:4d}" for r in worst_entities(audited).collect()]])


def sampled_formats(rows: DataFrame, keys: list[str], order: str, k: int = 200) -> DataFrame:
    """keys, formats: the date formats among the first k given dates (by `order`) of each group, joined by |."""
    given = rows.where(F.trim(F.coalesce("date", F.lit(""))) != "")
    first = given.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= k)
    return first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(date_format(F.col("date")))), "|").alias("formats"))


def mismatched_names(rows: DataFrame, name: str = "district_name") -> DataFrame:
    """district, names: what files call their district (trimmed) where that is not the district's name, whatever the case."""
    said = F.trim(name)
    other = rows.where(said.isNotNull() & (F.lower(said) != F.lower("district")))
    return other.groupBy("district").agg(F.array_join(F.array_sort(F.collect_set(said)), "|").alias("names"))


def header_flags(columns: list[str]) -> dict[str, object]:
    """C1 to C3 of one file's header: canonical columns that are missing, under another name, or unknown."""
    from ..resolve import canonical_names

    found = canonical_names(columns)
    wanted = ("date", "market_id", *PRICES)
    other = [c for k, c in found.items() if c != k]
    extra = [c for c in columns if c not in found.values()]
    missing = [k for k in wanted if k not in found]
    return {"C1_missing_cols": bool(missing), "missing_cols": "|".join(missing), "C2_nonstandard_names": bool(other), "nonstandard_cols": "|".join(other), "C3_extra_cols": bool(extra), "extra_cols": "|".join(extra)}


def summary(audited: DataFrame) -> DataFrame:
    """flag, files: how many files have each flag."""
    flags = [c for c, k in audited.dtypes if k == "boolean"]
    counted = audited.agg(*[F.count_if(F.col(c)).alias(c) for c in flags])
    return counted.unpivot([], flags, "flag", "files")
