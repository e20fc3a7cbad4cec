"""Sources and sinks of text tables, rasters, boundaries and landed API answers. All files are reached through Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import crop_year, is_leap, parse_by_majority, year_in_name
from ..functions.numbers import to_number
from ..operators import geo
from ..resolve import CANDIDATES, column_place, pattern_place


def listed(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """path, filename, district (the folder's name, or the file's own in a flat layout), size: recursively, without contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"))
    return files.select("path", *_place(F.col("path")), "size")


# The characters of Windows code page 1252 at 0x80 to 0x9F (the five places it leaves open stay control characters).
CP1252 = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"


def decoded(line: Column) -> Column:
    """A text file's line as it was meant: UTF-8 where all of its bytes are, else ISO-8859-1 with the printable characters of Windows-1252."""
    latin = F.translate(F.decode(line.cast("binary"), "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    return F.when(F.is_valid_utf8(line), line).otherwise(latin)


def _place(path: Column) -> list[Column]:
    """district (the folder's name where files are called by year, else the file's own) and filename of a path."""
    name, folder = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return [F.when(name.rlike(r"^\d{4}\."), folder).otherwise(F.regexp_replace(name, r"\.[^.]*$", "")).alias("district"), name.alias("filename")]


def lines(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """path (as it is called, not as a URI), value (decoded), begins (whether the line is of its file's first split), i (its order there).

    Lines without a visible character are left out.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    # the metadata's path is percent-encoded; a plus sign in it is one
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = raw.select(path.alias("path"), decoded(F.col("value")).alias("value"), (F.col("_metadata.file_block_start") == 0).alias("begins"), F.monotonically_increasing_id().alias("i"))
    return found.where(F.trim(F.regexp_replace("value", "\ufeff", "")) != "")


def fields(line: Column) -> Column:
    """The fields of a line of a CSV file: quotes taken off, doubled quotes single, empty fields null."""
    pieces = F.regexp_extract_all(line, F.lit(r'(?:^|,)(?:[^",]*"(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(0))
    bare = lambda f: F.regexp_replace(f, "^,", "")
    quoted = lambda f: F.when(bare(f).rlike(r'^\s*"'), F.replace(F.regexp_replace(bare(f), r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(bare(f))
    split = F.when(F.contains(line, F.lit('"')), F.transform(pieces, quoted)).otherwise(F.split(line, ","))
    return F.transform(split, lambda f: F.nullif(f, F.lit("")))


def heads(spark: SparkSession, root: str) -> DataFrame:
    """path, header (the first line as it stands), columns of the CSV files under root that are not empty."""
    first = lines(spark, root).where("begins").groupBy("path").agg(F.min_by("value", "i").alias("header"))
    names = F.transform(fields(F.regexp_replace("header", "^\ufeff", "")), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    return first.select("path", "header", names.alias("columns"))


def _rows(spark: SparkSession, root: str, layout: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """path, `keep` of the layout and the named fields (text) of all data lines. layout: path, header, and for each name its place or null.

    One read for all layouts, joined with the table of headers. A line that repeats its file's header is no data.
    """
    placed = layout.select(F.col("path").alias("_path"), F.col("header").alias("_header"), *[F.col(n).alias(f"_at_{n}") for n in names], *keep)
    data = lines(spark, root).select("path", F.col("value").alias("_line")).join(placed, F.col("path") == F.col("_path")).where(F.col("_line") != F.col("_header"))
    return data.withColumn("_f", fields(F.col("_line"))).select("path", *keep, *[F.get("_f", F.col(f"_at_{n}")).alias(n) for n in names])


def read_prices(spark: SparkSession, root: str) -> DataFrame:
    """Text rows of all price files, whatever their headers call the columns; files without a date or modal price are skipped.

    An empty field is null; a quoted field may hold commas, but no line break.
    """
    names = ("market_id", "date", "min_price", "max_price", "modal_price")
    layout = heads(spark, root).select("path", "header", *[column_place(F.col("columns"), CANDIDATES[n]).alias(n) for n in names]).where("date is not null and modal_price is not null")
    return _rows(spark, root, layout, names).select(*_place(F.col("path")), *names)


def daily_prices(rows: DataFrame) -> DataFrame:
    """Typed, distinct price rows with year and month; rows without a readable date or district are dropped."""
    typed = parse_by_majority(rows, "filename", "date", "_d").withColumns({c: to_number(F.col(c)) for c in ("min_price", "max_price", "modal_price")})
    kept = typed.where(F.col("_d").isNotNull() & (F.trim(F.coalesce("district", F.lit(""))) != ""))
    return kept.drop("date").withColumnRenamed("_d", "date").withColumns({"year": F.year("date"), "month": F.month("date")}).dropDuplicates(["district", "market_id", "date", "min_price", "max_price", "modal_price"])


def header_only(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Listed files without any data row."""
    return files.join(rows.select("district", "filename").distinct(), ["district", "filename"], "left_anti")


def unreadable(files: DataFrame, rows: DataFrame) -> DataFrame:
    """district, filename, F2_empty_file, F3_header_only of files without rows: the audit's early returns."""
    return header_only(files, rows).select("district", "filename", (F.col("size") == 0).alias("F2_empty_file"), (F.col("size") > 0).alias("F3_header_only"))


def years_present(rows: DataFrame) -> DataFrame:
    """district, year of files named by a year that hold a row."""
    return rows.select("district", F.regexp_extract("filename", r"^(\d{4})\.csv$", 1).try_cast("int").alias("year")).where("year is not null").distinct()


def read_metric(spark: SparkSession, root: str, state: str, names: dict[str, str] | None = None) -> DataFrame:
    """unit (file), year, district, season, value of yearly metric files: state filtered, year from the name.

    Files without a district or value column are skipped; where there is no state column all rows are the state's.
    names: districts as the files call them -> as the map does (functions.rates.APY_NAMES); others keep their names.
    """
    patterns = {"state": ("state",), "district": ("district",), "season": ("season",), "value": ("area", "production", "yield")}
    places = heads(spark, root).select("path", "header", *[pattern_place(F.col("columns"), p).alias(k) for k, p in patterns.items()])
    layout = places.where("district is not null and value is not null").withColumn("any_state", F.col("state").isNull())
    data = _rows(spark, root, layout, tuple(patterns), keep=("any_state",))
    rows = data.where(F.col("any_state") | (F.lower(F.trim("state")) == state.lower()))
    unit = _place(F.col("path"))[1]
    own = F.trim("district")
    called = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), own), own) if names else own
    out = rows.select(unit.alias("unit"), year_in_name(unit).alias("year"), called.alias("district"), "season", to_number(F.col("value")).alias("value"))
    return out.where("value is not null and district is not null and district <> ''")


def with_crop_year(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("year", crop_year(F.col(column)))


def read_raster(spark: SparkSession, root: str, rows: int, columns: int, missing_from: float = 90.0, plausible: tuple[float, float] = (-30.0, 60.0)) -> DataFrame:
    """year, day, lat_idx, lon_idx, value of float32 rasters (days x rows x columns), one file a year; files of a wrong size are skipped.

    Byte order is the one in which more of the values are plausible.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content, year, days in zip(frame["content"], frame["year"], frame["days"]):
                if len(content) != 4 * days * rows * columns:
                    continue
                ways = [np.frombuffer(content, dtype=t) for t in ("<f4", ">f4")]
                good = [np.mean((w >= plausible[0]) & (w <= 100)) for w in ways]
                x = ways[int(good[1] > good[0])].astype(np.float64).reshape(days, rows, columns)
                for d in range(days):
                    lat, lon = np.nonzero(x[d] < missing_from)
                    yield pd.DataFrame({"year": np.int32(year), "day": np.int32(d + 1), "lat_idx": lat.astype(np.int32), "lon_idx": lon.astype(np.int32), "value": x[d][lat, lon]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{GRD,grd}").load(root)
    named = files.select("content", year_in_name(F.regexp_extract("path", r"([^/]+)$", 1)).alias("year")).where("year is not null")
    sized = named.withColumn("days", F.when(is_leap(F.col("year")), 366).otherwise(365))
    return sized.mapInPandas(decode, "year int, day int, lat_idx int, lon_idx int, value double")


def read_boundaries(spark: SparkSession, path: str, name: str, within: tuple[str, str] | None = None) -> DataFrame:
    """name, ring, rings of every polygon of a GeoJSON file: the outer ring, and all rings with their holes (each part of a multipolygon is a row).

    Rings are oriented: outer ones clockwise, holes against it. within: (property, text) that a feature's property must
    hold, whatever its case.
    """
    feature = "struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    if within:
        raw = raw.where(F.contains(F.lower(F.element_at("f.properties", within[0])), F.lit(within[1].lower())))
    ring = "array<array<array<double>>>"
    shapes = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{ring}>")).otherwise(F.array(F.from_json("f.geometry.coordinates", ring)))
    parts = raw.select(F.element_at("f.properties", name).alias(name), F.explode(shapes).alias("p"))
    point = lambda q: F.struct(F.get(q, 0).alias("lon"), F.get(q, 1).alias("lat"))
    rings = parts.withColumn("rings", F.transform("p", lambda r, i: geo.oriented(F.transform(r, point), i == 0)))
    return rings.select(name, F.transform(F.get("p", 0), point).alias("ring"), "rings")


def read_answers(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of landed API answers ({"output": {"type", "message", "data": [...]}}), one JSON document a file or line."""
    answers = spark.read.schema(f"output struct<type: string, message: string, data: array<struct<{fields}>>>").option("multiLine", "true").json(path)
    return answers.where("output.data is not null").select(F.inline("output.data"))


def market_map(answers: DataFrame) -> DataFrame:
    """district_id, name, market_id, market_name of a map of districts with their markets (column `markets`)."""
    return answers.select(F.explode("markets").alias("district_id", "d")).select("district_id", F.col("d.name").alias("name"), F.inline("d.markets"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A panel or feature table as Parquet."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("errorifexists").parquet(path)


def write_new(df: DataFrame, path: str, keys: list[str], existing: DataFrame) -> None:
    """Append rows whose keys no existing row has: what is there is never overwritten."""
    df.join(existing.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)


def writable(planned: DataFrame, files: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Planned units that may be written: without a file, or with one that gives no rows (header only, or unreadable)."""
    real = files.select(*keys).join(rows.select(*keys).distinct(), keys, "left_semi")
    return planned.join(real.distinct(), keys, "left_anti")


def write_units(df: DataFrame, path: str, keys: list[str], existing: DataFrame) -> None:
    """Write the units (partitions by keys) of df of which `existing` has no row, replacing what stands there; units with real rows stay."""
    fresh = df.join(existing.select(*keys).distinct(), keys, "left_anti")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_metadata(spark: SparkSession, path: str, **values: object) -> None:
    """A run's counts and parameters as one JSON row."""
    from pyspark.sql import Row

    spark.createDataFrame([Row(**values)]).coalesce(1).write.mode("overwrite").json(path)
