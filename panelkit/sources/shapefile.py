"""Polygons of shapefiles as a Spark data source: each task reads a range of shapes through the index.

spark.dataSource.register(ShapefileSource)
spark.read.format("shapefile").load("districts.shp")

The driver reads the size of the index and the field descriptions of the attributes. A task reads its range of the index
(.shx), of the attributes (.dbf) and those bytes of the shapes (.shp) that its index entries name. One row a shape: the
attributes, and `rings`, all of its rings (outer ones and holes, in the file's coordinates, outer ones clockwise).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import geo
from .files import Opened

RINGS = "rings array<array<struct<lon: double, lat: double>>>"
#: Shape types of polygons: plain, with heights, with measures. Others have null rings.
POLYGONS = (5, 15, 25)
KINDS = {"L": "boolean", "N": "double", "F": "double"}


@dataclass
class Fields:
    """Field descriptions of a .dbf file: (name, type, decimals, from, length) of each, and where its records begin."""

    records: int
    begin: int
    size: int
    items: list[tuple[str, str, int, int, int]]

    def spark_type(self, kind: str, decimals: int, length: int) -> str:
        return "bigint" if kind == "N" and not decimals and length <= 18 else KINDS.get(kind, "string")


def described(path: str) -> Fields:
    with Opened(path) as file:
        records, begin, size = struct.unpack("<IHH", file.read(4, 8))
        raw, at, items = file.read(32, begin - 32), 1, []
        for i in range(0, len(raw) - 31, 32):
            if raw[i] == 0x0D:
                break
            length = raw[i + 16]
            items.append((raw[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(raw[i + 11]), raw[i + 17], at, length))
            at += length
        return Fields(records, begin, size, items)


def attribute(raw: bytes, kind: str, spark_type: str, encoding: str) -> object:
    try:
        text = raw.decode(encoding)
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    text = text.strip(" \0")
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if kind in "NF":
        try:
            return int(text) if spark_type == "bigint" else float(text)
        except ValueError:
            return None
    return text or None


def rings(shape: bytes) -> list[list[tuple[float, float]]] | None:
    """The rings of a shape's content; None if it is no polygon."""
    if len(shape) < 4 or struct.unpack_from("<i", shape)[0] not in POLYGONS:
        return None
    parts, points = struct.unpack_from("<2i", shape, 36)
    begins = [*struct.unpack_from(f"<{parts}i", shape, 44), points]
    flat = struct.unpack_from(f"<{2 * points}d", shape, 44 + 4 * parts)
    return [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(begins[:-1], begins[1:])]


@dataclass
class Range(InputPartition):
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.first, self.last))


def _beside(path: str, suffix: str) -> str:
    return re.sub(r"\.shp$", suffix, path, flags=re.IGNORECASE)


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, fields: Fields, shapes: int, encoding: str) -> None:
        self.path, self.fields, self.shapes, self.encoding = path, fields, shapes, encoding

    def partitions(self) -> list[InputPartition]:
        with Opened(_beside(self.path, ".shx")) as index:
            n = (index.size - 100) // 8
        return [Range(a, min(a + self.shapes, n)) for a in range(0, n, self.shapes)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        n, f = part.last - part.first, self.fields
        with Opened(self.path) as shapes, Opened(_beside(self.path, ".shx")) as index, Opened(_beside(self.path, ".dbf")) as table:
            places = struct.unpack(f">{2 * n}i", index.read(100 + 8 * part.first, 8 * n))
            for k in range(n):
                row = table.read(f.begin + (part.first + k) * f.size, f.size)
                if row[:1] == b"*":  # deleted
                    continue
                # places and lengths are in 16-bit words; a record's content follows its header of 8 bytes
                content = shapes.read(2 * places[2 * k] + 8, 2 * places[2 * k + 1])
                cells = [attribute(row[at : at + size], kind, f.spark_type(kind, decimals, size), self.encoding) for _, kind, decimals, at, size in f.items]
                yield (*cells, rings(content))


class ShapefileSource(DataSource):
    """options: path (of the .shp file), shapes (a task's, 1,000), encoding (of the attributes; latin-1 where a value does not fit it)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = described(_beside(self.options["path"], ".dbf"))
        return ", ".join([*[f"`{n}` {fields.spark_type(k, d, size)}" for n, k, d, _, size in fields.items], RINGS])

    def reader(self, schema: object) -> DataSourceReader:
        path = self.options["path"]
        return ShapeReader(path, described(_beside(path, ".dbf")), int(self.options.get("shapes", "1000")), self.options.get("encoding", "utf-8"))


def degrees(projection: str | None) -> Column:
    """`rings` in degrees, by the text of a .prj file: unchanged for geographic coordinates, turned back from a transverse Mercator grid.

    Only the projection is undone; a datum other than WGS 84 moves points by some metres to a few hundred.
    """
    if not projection or not projection.lstrip().upper().startswith(("PROJCS", "PROJCRS")):
        return F.col("rings")
    if "transverse_mercator" not in projection.lower().replace(" ", "_"):
        raise ValueError("only geographic coordinates and transverse Mercator grids are read")
    number = r"\s*([-+0-9.eE]+)"
    spheroid = re.search(rf'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,{number}\s*,{number}', projection)
    have = {m[1].lower().replace(" ", "_"): float(m[2]) for m in re.finditer(rf'PARAMETER\s*\[\s*"([^"]*)"\s*,{number}', projection)}
    unit = [float(x) for x in re.findall(rf'(?:LENGTHUNIT|UNIT)\s*\[\s*"[^"]*"\s*,{number}', projection)][-1:] or [1.0]
    a, inverse = (float(spheroid[1]), float(spheroid[2])) if spheroid else (6378137.0, 298.257223563)
    grid = geo.Grid(a, 1 / inverse if inverse else 0.0, have.get("latitude_of_origin", 0.0), have.get("central_meridian", 0.0), have.get("scale_factor", 1.0), have.get("false_easting", 0.0), have.get("false_northing", 0.0), unit[0])
    return F.transform("rings", lambda ring: F.transform(ring, lambda p: geo.from_transverse_mercator(p["lon"], p["lat"], grid)))


def read_shapes(spark: SparkSession, path: str, shapes: int = 1000) -> DataFrame:
    """The attributes of a shapefile's polygons and their rings in degrees."""
    spark.dataSource.register(ShapefileSource)
    options = {"shapes": str(shapes)}
    try:
        with Opened(_beside(path, ".cpg")) as file:
            options["encoding"] = file.read(0, file.size).decode("ascii", "replace").strip() or "utf-8"
        "".encode(options["encoding"])
    except (OSError, LookupError):
        options["encoding"] = "utf-8"
    try:
        with Opened(_beside(path, ".prj")) as file:
            projection = file.read(0, file.size).decode("utf-8", "replace")
    except OSError:
        projection = None
    return spark.read.format("shapefile").options(**options).load(path).withColumn("rings", degrees(projection))


def read_districts(spark: SparkSession, path: str, state: str) -> DataFrame:
    """district, rings of the shapes of a state.

    The state's column is NAME_1 if that names it, else the first text column of which some value does; the district's is
    NAME_2, else the first other one without repeats whose values are longer than 3 on average, else the first other one.
    """
    from ..resolve import column_by_content, identifier_column

    found = read_shapes(spark, path)
    columns = [c for c in found.columns if c != "rings"]
    first = found.select("NAME_1") if "NAME_1" in columns else None
    column = "NAME_1" if first is not None and column_by_content(first, state) else column_by_content(found.select(*columns), state)
    if column is None:
        raise ValueError(f"no column holds '{state}': {', '.join(columns)}")
    own = found.where(F.contains(F.lower(F.col(column)), F.lit(state.lower())))
    others = [c for c in columns if c != column]
    name = "NAME_2" if "NAME_2" in others else identifier_column(own.select(*others)) or next(iter(others), None)
    if name is None:
        raise ValueError(f"no column is left for the district: {', '.join(columns)}")
    return own.select(F.col(name).cast("string").alias("district"), "rings")
