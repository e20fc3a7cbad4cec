"""Grid cells and polygons: containment by ray casting, nearest cell, centroids, means over an entity's cells."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(anchors: DataFrame, lat0: float, lon0: float, rows: int, columns: int, step: float = 1.0) -> DataFrame:
    """lat_idx, lon_idx, lat, lon of every cell centre. anchors: any one-row frame of the session to build on."""
    cells = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("lat_idx")).withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return cells.withColumns({"lat": lat0 + step * F.col("lat_idx"), "lon": lon0 + step * F.col("lon_idx")})


def in_box(places: DataFrame, lon: tuple[float, float], lat: tuple[float, float], name: str, homonyms: tuple[tuple[str, Column], ...] = ()) -> DataFrame:
    """Places strictly inside a box of columns lon and lat, but for homonyms: (name, condition) of places meant to be elsewhere."""
    kept = (F.col("lon") > lon[0]) & (F.col("lon") < lon[1]) & (F.col("lat") > lat[0]) & (F.col("lat") < lat[1])
    for other, where in homonyms:
        kept &= ~((F.col(name) == other) & where)
    return places.where(kept)


def _edges(ring: Column) -> Column:
    """struct<a, b> of a ring's edges (array of struct<lon, lat>, closed or not); none of a ring that is null or empty."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<a: struct<lon: double, lat: double>, b: struct<lon: double, lat: double>>>"))


def _crossing(edge: Column, lat: Column) -> Column:
    """Where an edge crosses a parallel; null if it does not."""
    a, b = edge["a"], edge["b"]
    at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
    return F.when((a["lat"] > lat) != (b["lat"] > lat), at)


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array of struct<lon, lat>, closed or not): crossings of a ray to the east are odd."""
    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(lon < _crossing(e, lat), F.lit(False)))) % 2 == 1


def inside_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether a point is in a shape of several rings: in an odd number of them, so holes are out and islands in holes in."""
    return F.size(F.filter(rings, lambda ring: inside(lon, lat, ring))) % 2 == 1


def _turn(edge: Column) -> Column:
    return edge["a"]["lon"] * edge["b"]["lat"] - edge["b"]["lon"] * edge["a"]["lat"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _centre(edges: Column) -> Column:
    area = _total(F.transform(edges, _turn))
    mean = lambda c: F.try_divide(_total(F.transform(edges, lambda e: (e["a"][c] + e["b"][c]) * _turn(e))), 3 * area)
    return F.when(area != 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def centroid(ring: Column) -> Column:
    """struct<lon, lat> of a ring by the shoelace formula; null for a ring without area."""
    return _centre(_edges(ring))


def centroid_rings(rings: Column) -> Column:
    """struct<lon, lat> of a shape of oriented rings (see oriented()): holes count against what they are cut out of."""
    return _centre(F.flatten(F.transform(rings, _edges)))


def oriented(ring: Column, clockwise: Column) -> Column:
    """The ring, turned round if it does not run clockwise as asked; the order of a ring without area stays."""
    area = _total(F.transform(_edges(ring), _turn))
    return F.when((area != 0) & ((area < 0) != clockwise), F.reverse(ring)).otherwise(ring)


def inner_point(rings: Column) -> Column:
    """struct<lon, lat> of a point inside a shape, however concave or holed: the middle of the widest piece of one parallel in it.

    The parallel is halfway between the heights of vertices around the middle of the shape, so it meets no vertex. Null for
    a shape without height.
    """
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["lat"])))
    middle = (F.array_min(heights) + F.array_max(heights)) / 2
    lat = (F.array_max(F.filter(heights, lambda h: h <= middle)) + F.array_min(F.filter(heights, lambda h: h > middle))) / 2
    edges = F.flatten(F.transform(rings, _edges))
    crossings = F.array_sort(F.filter(F.transform(edges, lambda e: _crossing(e, lat)), lambda x: x.isNotNull()))
    # the shape lies between the first and second crossing, the third and fourth, ...
    pieces = F.transform(F.sequence(F.lit(0), F.size(crossings) - 2, F.lit(2)), lambda i: F.struct((F.get(crossings, i + 1) - F.get(crossings, i)).alias("width"), (-i).alias("first")))
    widest = -F.array_max(pieces)["first"]
    point = F.struct(((F.get(crossings, widest) + F.get(crossings, widest + 1)) / 2).alias("lon"), lat.alias("lat"))
    return F.when(F.size(crossings) >= 2, point)


class Grid(NamedTuple):
    """A transverse Mercator grid: the ellipsoid's radius and flattening, origin in degrees, scale, false origin, metres a unit."""

    radius: float = 6378137.0
    flattening: float = 1 / 298.257223563
    latitude: float = 0.0
    meridian: float = 0.0
    scale: float = 1.0
    easting: float = 0.0
    northing: float = 0.0
    unit: float = 1.0


def from_transverse_mercator(x: Column, y: Column, grid: Grid) -> Column:
    """struct<lon, lat> in degrees of grid coordinates, by Krueger's series in the third flattening (to some micrometres near the meridian)."""
    n = grid.flattening / (2 - grid.flattening)
    radius = grid.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    # the meridian arc from the equator to the origin, on the rectifying sphere
    phi, e = math.radians(grid.latitude), 2 * math.sqrt(n) / (1 + n)
    conformal = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
    start = conformal + sum(a * math.sin(2 * j * conformal) for j, a in enumerate(alpha, 1))
    xi = (y * grid.unit - grid.northing * grid.unit) / (radius * grid.scale) + start
    eta = (x * grid.unit - grid.easting * grid.unit) / (radius * grid.scale)
    flat = lambda f, g, sign: [sign * b * f(2 * j * xi) * g(2 * j * eta) for j, b in enumerate(beta, 1)]
    xi1, eta1 = xi + sum(flat(F.sin, F.cosh, -1), F.lit(0.0)), eta + sum(flat(F.cos, F.sinh, -1), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), F.lit(0.0))
    lon = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.struct((F.degrees(lon) + grid.meridian).alias("lon"), F.degrees(lat).alias("lat"))


def boxed(polygons: DataFrame, size: float) -> DataFrame:
    """polygons with one row for each tile of `size` degrees that their bounding box touches: _x, _y."""
    points = F.flatten("rings") if "rings" in polygons.columns else F.col("ring")
    edge = lambda c, f: f(F.transform(points, lambda p: p[c]))
    x = F.sequence(F.floor(edge("lon", F.array_min) / size), F.floor(edge("lon", F.array_max) / size))
    y = F.sequence(F.floor(edge("lat", F.array_min) / size), F.floor(edge("lat", F.array_max) / size))
    return polygons.withColumn("_x", F.explode(x)).withColumn("_y", F.explode(y))


def contained(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """Points with the polygons that hold them (left: null if none; a point in two gives two rows).

    polygons have `rings` (outer ones and holes) or one `ring`. Points meet only polygons whose bounding box touches
    their tile: an equi-join, not all pairs.
    """
    p = points.withColumns({"_x": F.floor(F.col("lon") / size), "_y": F.floor(F.col("lat") / size)})
    near = p.join(boxed(polygons, size), ["_x", "_y"])
    holds = inside_rings(F.col("lon"), F.col("lat"), F.col("rings")) if "rings" in polygons.columns else inside(F.col("lon"), F.col("lat"), F.col("ring"))
    hits = near.where(holds).drop("ring", "rings", "_x", "_y")
    return points.join(hits.select(*[c for c in hits.columns if c in points.columns], *[c for c in hits.columns if c not in points.columns]), points.columns, "left")


def nearest_cell(targets: DataFrame, cells: DataFrame, lat0: float, lon0: float, rows: int, columns: int, step: float = 1.0) -> DataFrame:
    """targets (lon, lat) with the nearest cell of a regular grid (least row, then column, on a tie).

    The nearest centre follows from rounding each coordinate to the grid, so nothing is compared in pairs; cells gives
    the columns to add.
    """
    place = lambda c, zero, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil((F.col(c) - zero) / step - 0.5))).cast("int")
    put = targets.withColumns({"lat_idx": place("lat", lat0, rows), "lon_idx": place("lon", lon0, columns)})
    return put.join(cells.drop("lat", "lon"), ["lat_idx", "lon_idx"])


def over_cells(raster: DataFrame, cell_map: DataFrame, entity: str, value: str) -> DataFrame:
    """Mean of a long raster (year, day, lat_idx, lon_idx, value) over each entity's cells and day, missing cells ignored."""
    return raster.join(cell_map, ["lat_idx", "lon_idx"]).groupBy(entity, "year", "day").agg(F.avg(value).alias(value))
