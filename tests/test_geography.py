"""Shapes with holes, points inside them, grids turned back to degrees, NetCDF and shapefiles written byte by byte."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import geo
from panelkit.sources import netcdf, shapefile, tables

SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
HOLE = [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0), (2.0, 2.0)]
ISLAND = [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0), (4.0, 4.0)]
COMB = [(0.0, 0.0), (0.0, 9.0), (1.0, 9.0), (1.0, 1.0), (4.0, 1.0), (4.0, 9.0), (9.0, 9.0), (9.0, 8.0), (5.0, 8.0), (5.0, 0.0)]
RINGS = "array<array<struct<lon: double, lat: double>>>"


def even_odd(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return n % 2 == 1


def shapes(spark, rows):
    return spark.createDataFrame(rows, f"name string, rings {RINGS}")


def test_points_in_shapes_with_holes(spark):
    rng = random.Random(1)
    held = {"square": [SQUARE], "ring": [SQUARE, HOLE], "island": [SQUARE, HOLE, ISLAND], "comb": [COMB], "two": [[(20.0, 0.0), (20.0, 2.0), (22.0, 0.0)], [(30.0, 0.0), (30.0, 2.0), (32.0, 2.0)]]}
    points = [(i, rng.uniform(-1, 33), rng.uniform(-1, 11)) for i in range(400)]
    got = geo.contained(spark.createDataFrame(points, "id int, lon double, lat double"), shapes(spark, list(held.items())), 3.0)
    want = {(i, name) for i, x, y in points for name, rings in held.items() if even_odd(x, y, rings)}
    assert {(r.id, r.name) for r in got.collect() if r.name} == want
    assert {r.id for r in got.collect()} == set(range(400))


def test_inner_points_and_centroids(spark):
    rng = random.Random(2)
    held = {"square": [SQUARE], "ring": [SQUARE, HOLE], "island": [SQUARE, HOLE, ISLAND], "comb": [COMB], "thin": [[(0.0, 0.0), (10.0, 0.001), (0.0, 0.002)]]}
    for k in range(40):  # stars, some very concave
        n = rng.randrange(3, 30)
        held[f"star {k}"] = [[(5 + r * math.cos(2 * math.pi * i / n), 5 + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [rng.uniform(0.2, 5)]]]
    rows = shapes(spark, list(held.items())).select("name", geo.inner_point(F.col("rings")).alias("p"), geo.centroid_rings(F.col("rings")).alias("c")).collect()
    for r in rows:
        assert even_odd(r.p.lon, r.p.lat, held[r.name]), r.name
    centre = {r.name: (r.c.lon, r.c.lat) for r in rows}
    assert centre["square"] == pytest.approx((5, 5)) and centre["ring"] == pytest.approx((5, 5))
    flat = shapes(spark, [("line", [[(0.0, 1.0), (1.0, 1.0)]]), ("none", []), ("null", None), ("empty", [[]])]).select(geo.inner_point(F.col("rings")).alias("p"), geo.centroid_rings(F.col("rings")).alias("c")).collect()
    assert all(r.p is None and r.c is None for r in flat)


def test_centroid_with_a_hole(spark):
    # 100 at (5, 5) less 4 at (2, 2)
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    for outer, inner in ((SQUARE, hole), (SQUARE[::-1], hole[::-1]), (SQUARE, hole[::-1])):
        rings = F.transform("rings", lambda r, i: geo.oriented(r, i == 0))
        c = shapes(spark, [("x", [outer, inner])]).select(geo.centroid_rings(rings).alias("c")).first().c
        assert (c.lon, c.lat) == pytest.approx(((500 - 8) / 96, (500 - 8) / 96))


def geojson(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}} for p, t, c in features]}))


def test_geojson_holes(spark, tmp_path):
    geojson(tmp_path / "b.json", [({"n": "ring"}, "Polygon", [SQUARE, HOLE]), ({"n": "parts"}, "MultiPolygon", [[ISLAND], [COMB]])])
    polygons = tables.read_boundaries(spark, str(tmp_path / "b.json"), "n")
    assert [(r.n, len(r.rings)) for r in polygons.collect()] == [("ring", 2), ("parts", 1), ("parts", 1)]
    points = spark.createDataFrame([(1, 1.0, 1.5), (2, 5.1, 5.2), (3, 7.0, 5.0)], "id int, lon double, lat double")
    assert {(r.id, r.n) for r in geo.contained(points, polygons.where("n = 'ring'")).collect()} == {(1, "ring"), (2, None), (3, None)}


# --- projections and shapefiles ----------------------------------------------------------------------------------------


def forward(lon, lat, grid):
    """Degrees to a transverse Mercator grid, by Krueger's forward series."""
    n = grid.flattening / (2 - grid.flattening)
    a = grid.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)

    def sphere(lon, lat):
        phi, d = math.radians(lat), math.radians(lon - grid.meridian)
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(d)), math.asinh(math.sin(d) / math.hypot(t, math.cos(d)))
        return xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)), eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))

    xi, eta = sphere(lon, lat)
    start = sphere(grid.meridian, grid.latitude)[0]
    return (grid.easting + a * grid.scale * eta / grid.unit, grid.northing + a * grid.scale * (xi - start) / grid.unit)


UTM44 = geo.Grid(meridian=81.0, scale=0.9996, easting=500000.0)
LOCAL = geo.Grid(radius=6377276.345, flattening=1 / 300.8017, latitude=26.0, meridian=80.0, scale=0.9998, easting=1000.0, northing=2000.0, unit=0.3048)


def test_transverse_mercator(spark):
    places = [(lon, lat) for lon in (78.2, 80.0, 81.0, 83.9) for lat in (-10.0, 0.0, 23.4, 31.0)]
    for grid in (UTM44, LOCAL):
        rows = [(*forward(*p, grid),) for p in places]
        got = spark.createDataFrame(rows, "x double, y double").coalesce(1).select(geo.from_transverse_mercator(F.col("x"), F.col("y"), grid).alias("p")).collect()
        for (lon, lat), r in zip(places, got):
            assert abs(r.p.lon - lon) < 1e-9 and abs(r.p.lat - lat) < 1e-9
    # a published pair: the Eiffel tower is at 448251.9 E, 5411943.8 N of UTM zone 31
    eiffel = spark.range(1).select(geo.from_transverse_mercator(F.lit(448251.9), F.lit(5411943.8), geo.Grid(meridian=3.0, scale=0.9996, easting=500000.0)).alias("p")).first().p
    assert eiffel.lon == pytest.approx(2.2945, abs=2e-4) and eiffel.lat == pytest.approx(48.8582, abs=2e-4)


def write_shapes(path, shapes, prj=None, encoding="utf-8", kind=5):
    """A .shp, .shx and .dbf of (NAME_1, NAME_2, AREA, rings) rows; rings None: a null shape."""
    body, index, records = b"", b"", b""
    for state, district, area, rings in shapes:
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            begins = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            content = struct.pack(f"<i4d2i{len(rings)}i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points), *begins) + b"".join(struct.pack("<2d", *p) for p in points)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", len(index) // 8, len(content) // 2) + content
        cell = lambda text, n: text.encode(encoding)[:n].ljust(n)
        records += b" " + cell(state, 20) + cell(district, 20) + str(area).rjust(8).encode()
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head(len(body)) + body)
    path.with_suffix(".shx").write_bytes(head(len(index)) + index)
    fields = b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([size, d]) + bytes(14) for n, k, size, d in (("NAME_1", "C", 20, 0), ("NAME_2", "C", 20, 0), ("AREA", "N", 8, 2)))
    path.with_suffix(".dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 26, 1, 1, len(shapes), 32 + len(fields) + 1, 49) + fields + b"\r" + records + b"\x1a")
    if prj:
        path.with_suffix(".prj").write_text(prj)


PRJ = 'PROJCS["WGS 84 / UTM zone 44N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",81],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]]'


def place(ring, by=0.1):
    return [(80 + by * x, 25 + by * y) for x, y in ring]


def test_shapefile_equals_its_geojson_twin(spark, tmp_path):
    rows = [("Uttar Pradesh", "Agra", 1.5, [place(SQUARE), place(HOLE)]), ("Bihar", "Patna", 2.0, [place(COMB)]), ("Uttar Pradesh", "Bara Banki", -3.25, [place(ISLAND), place(COMB)]), ("Uttar Pradesh", "Étah", 0, None)]
    for name, prj, grid in (("plain", None, None), ("grid", PRJ, UTM44)):
        turned = [(s, d, a, [[forward(*p, grid) if grid else p for p in r] for r in rings] if rings else None) for s, d, a, rings in rows]
        write_shapes(tmp_path / name, turned, prj)
        for shapes_a_task in (1, 3, 1000):
            got = shapefile.read_shapes(spark, str(tmp_path / f"{name}.shp"), shapes_a_task)
            assert got.dtypes[:3] == [("NAME_1", "string"), ("NAME_2", "string"), ("AREA", "double")]
            found = {r.NAME_2: r for r in got.collect()}
            assert {k: (r.NAME_1, r.AREA) for k, r in found.items()} == {d: (s, a) for s, d, a, _ in rows}
            for _, d, _, rings in rows:
                have = None if found[d].rings is None else [[(p.lon, p.lat) for p in r] for r in found[d].rings]
                assert (have is None) == (rings is None)
                for a, b in zip(have or [], rings or []):
                    assert np.allclose(a, b, atol=1e-9)
    geojson(tmp_path / "twin.json", [({"d": d}, "Polygon", r) for _, d, _, r in rows[:2]])
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(79.9, 81.1), rng.uniform(24.9, 26.1)) for i in range(300)], "id int, lon double, lat double")
    twin = {(r.id, r.d) for r in geo.contained(points, tables.read_boundaries(spark, str(tmp_path / "twin.json"), "d")).collect() if r.d}
    shape = shapefile.read_shapes(spark, str(tmp_path / "grid.shp")).where("NAME_2 in ('Agra', 'Patna')").select("NAME_2", "rings")
    assert {(r.id, r.NAME_2) for r in geo.contained(points, shape).collect() if r.NAME_2} == twin and len(twin) > 50


def test_districts_of_a_state(spark, tmp_path):
    rows = [("Uttar Pradesh", "Agra", 1, [SQUARE]), ("Bihar", "Patna", 2, [COMB]), ("UTTAR PRADESH", "Étah", 3, [ISLAND])]
    write_shapes(tmp_path / "a b", rows, encoding="latin-1")
    assert {r.district for r in shapefile.read_districts(spark, str(tmp_path / "a b.shp"), "uttar pradesh").collect()} == {"Agra", "Étah"}
    with pytest.raises(ValueError):
        shapefile.read_districts(spark, str(tmp_path / "a b.shp"), "Kerala")
    write_shapes(tmp_path / "none", [])
    assert shapefile.read_shapes(spark, str(tmp_path / "none.shp")).count() == 0
    with pytest.raises(ValueError):
        shapefile.degrees('PROJCS["x",PROJECTION["Lambert_Conformal_Conic"]]')


# --- NetCDF ------------------------------------------------------------------------------------------------------------


def text(s, wide=False):
    b = s.encode()
    return struct.pack(">q" if wide else ">i", len(b)) + b + bytes(-len(b) % 4)


def write_netcdf(path, data, version=1, unlimited=True, kind=5, attributes=b"", n_attributes=0, streamed=False, beside=False):
    """A file with RAINFALL(TIME, LAT, LON); beside: another record variable before it, so that records interleave."""
    days, rows, columns = data.shape
    count, offset, wide = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q"), version == 5
    dims = b"".join(text(n, wide) + struct.pack(count, k) for n, k in (("TIME", 0 if unlimited else days), ("LATITUDE", rows), ("LONGITUDE", columns)))
    raw = data.astype(netcdf.TYPES[kind])
    day = rows * columns * raw.dtype.itemsize
    time = struct.pack(">d", 1.0)

    def header(begin, begin_time):
        n = 2 if beside else 1
        none = struct.pack(">i", 0) + struct.pack(count, 0)
        out = b"CDF" + bytes([version]) + struct.pack(count, (-1 if streamed else days) if unlimited else 0)
        out += struct.pack(">i", 10) + struct.pack(count, 3) + dims + none + struct.pack(">i", 11) + struct.pack(count, n)
        if beside:
            out += text("TIME", wide) + struct.pack(count, 1) + struct.pack(count, 0) + none + struct.pack(">i", 6) + struct.pack(count, 8) + struct.pack(offset, begin_time)
        held = struct.pack(">i", 12) + struct.pack(count, n_attributes) + attributes if n_attributes else none
        out += text("RAINFALL", wide) + struct.pack(count, 3) + b"".join(struct.pack(count, i) for i in range(3)) + held
        return out + struct.pack(">i", kind) + struct.pack(count, day + -day % 4) + struct.pack(offset, begin)

    at = len(header(0, 0))
    head = header(at + (8 if beside else 0), at)
    pad = bytes(-day % 4) if beside else b""
    records = [(time if beside else b"") + raw[d].tobytes() + pad for d in range(days)]
    path.write_bytes(head + b"".join(records))


def cells(df):
    return {(r.year, r.day, r.lat_idx, r.lon_idx): r.value for r in df.collect()}


def expected(year, data):
    return {(year, d + 1, i, j): float(data[d, i, j]) for d, i, j in zip(*np.nonzero(np.where(np.isnan(data), -999, data) > -998))}


def rain(seed, days=11, rows=3, columns=5):
    rng = np.random.RandomState(seed)
    x = rng.gamma(0.5, 20, (days, rows, columns)).round(2)
    x[rng.rand(*x.shape) < 0.2] = -999.0
    return x


@pytest.mark.parametrize("version,unlimited,streamed,beside", [(1, True, False, False), (1, False, False, False), (2, True, True, False), (2, True, False, True), (5, True, False, True), (5, False, False, False)])
def test_netcdf_layouts(spark, tmp_path, version, unlimited, streamed, beside):
    x = rain(version)
    write_netcdf(tmp_path / "RF25_ind2007_rfp25.nc", x, version, unlimited, 6, streamed=streamed, beside=beside)
    for slab in (50, 1 << 20):
        df = netcdf.read_rain(spark, str(tmp_path), slab_bytes=slab)
        assert cells(df) == expected(2007, x)
    size = (tmp_path / "RF25_ind2007_rfp25.nc").stat().st_size
    assert netcdf.read_rain(spark, str(tmp_path), slab_bytes=200).rdd.getNumPartitions() == -(-size // 200)


def test_netcdf_scaled_and_filled(spark, tmp_path):
    x = np.array([[[10, 20, -32768], [0, 5, 7]]] * 2)
    scaled = text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("_FillValue") + struct.pack(">iih", 3, 1, -32768) + b"\0\0" + text("units") + struct.pack(">ii", 2, 2) + b"mm\0\0"
    write_netcdf(tmp_path / "rain 2010.nc", x, kind=3, attributes=scaled, n_attributes=3)
    want = {(2010, d, i, j): x[0, i, j] * 0.5 for d in (1, 2) for i in range(2) for j in range(3) if x[0, i, j] != -32768}
    assert cells(netcdf.read_rain(spark, str(tmp_path / "rain 2010.nc"))) == want


def test_bad_netcdf_files_are_skipped_whole(spark, tmp_path):
    good, other = rain(7), rain(8)
    write_netcdf(tmp_path / "a_2001.nc", good)
    write_netcdf(tmp_path / "a_2002.nc", other)
    cut = (tmp_path / "a_2002.nc").read_bytes()
    (tmp_path / "a_2002.nc").write_bytes(cut[:-7])
    (tmp_path / "b_2003.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(500))
    (tmp_path / "c_2004.nc").write_bytes(cut[:60])
    (tmp_path / "d_2005.nc").write_bytes(b"")
    (tmp_path / "no year.nc").write_bytes(cut)
    (tmp_path / "notes_2006.txt").write_text("x")
    write_netcdf(tmp_path / "e_2008.nc", good)
    got = cells(netcdf.read_rain(spark, str(tmp_path), slab_bytes=64))
    f4 = {k: float(np.float32(v)) for y in (2001, 2008) for k, v in expected(y, good).items()}
    assert got == f4
    assert netcdf.read_rain(spark, str(tmp_path), variable="TMAX").count() == 0
    with pytest.raises(Exception, match="cut off"):
        netcdf.read_rain(spark, str(tmp_path), strict=True).count()
    (tmp_path / "none").mkdir()
    assert netcdf.read_rain(spark, str(tmp_path / "none")).count() == 0
