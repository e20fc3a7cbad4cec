"""Sources, sinks and incremental ingest on files written here."""

import json

import numpy as np
from pyspark.sql import functions as F

from panelkit.functions.rates import APY_NAMES
from panelkit.sources import tables
from panelkit.streaming import arrivals


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_price_files(spark, tmp_path):
    put(tmp_path / "Agra/2010.csv", 'Price Date,market_id,Min_x0020_Price,Max Price,Modal_Price\n2010-01-02,1,10,20,"1,500"\n2010-01-02,1,10,20,"1,500"\nbad,1,1,2,3\n')
    put(tmp_path / "Agra/2011.csv", "Price Date,market_id,Min_x0020_Price,Max Price,Modal_Price\n")
    put(tmp_path / "Flat.csv", "modal price,date\n7,03/04/2012\n")
    put(tmp_path / "Other/2012.csv", "a,b\n1,2\n")
    rows = tables.read_prices(spark, str(tmp_path))
    assert sorted((r.district, r.filename, r.modal_price) for r in rows.collect()) == [("Agra", "2010.csv", "1,500"), ("Agra", "2010.csv", "1,500"), ("Agra", "2010.csv", "3"), ("Flat", "Flat.csv", "7")]
    daily = tables.daily_prices(rows).collect()
    assert sorted((r.district, str(r.date), r.modal_price, r.year, r.month) for r in daily) == [("Agra", "2010-01-02", 1500.0, 2010, 1), ("Flat", "2012-04-03", 7.0, 2012, 4)]
    files = tables.listed(spark, str(tmp_path))
    assert {(r.district, r.filename) for r in tables.header_only(files, rows).collect()} == {("Agra", "2011.csv"), ("Other", "2012.csv")}
    assert {(r.district, r.year) for r in tables.years_present(rows).collect()} == {("Agra", 2010)}
    assert all(r.F3_header_only and not r.F2_empty_file for r in tables.unreadable(files, rows).collect())


def test_metric_files(spark, tmp_path):
    put(tmp_path / "area_2007.csv", "StateName,DistrictName,SeasonName,Area\nUttar Pradesh , Agra,Rabi,12\nBihar,Patna,Rabi,1\nUTTAR PRADESH,Kheri,Total,x\n")
    got = tables.read_metric(spark, str(tmp_path), "uttar pradesh").collect()
    assert [(r.unit, r.year, r.district, r.season, r.value) for r in got] == [("area_2007.csv", 2007, "Agra", "Rabi", 12.0)]


def test_raster(spark, tmp_path):
    x = np.full((365, 2, 3), 20, dtype="<f4")
    x[0, 0, 0], x[1, 1, 2] = 99.9, -5
    (tmp_path / "t_2001.GRD").write_bytes(x.tobytes())
    (tmp_path / "t_2002.GRD").write_bytes(x.astype(">f4").tobytes())
    (tmp_path / "t_2003.GRD").write_bytes(b"short")
    got = tables.read_raster(spark, str(tmp_path), 2, 3)
    assert {r.year: (r.n, r.low) for r in got.groupBy("year").agg(F.count("*").alias("n"), F.min("value").alias("low")).collect()} == {2001: (365 * 6 - 1, -5), 2002: (365 * 6 - 1, -5)}


def test_boundaries_and_answers(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [("A", "Uttar Pradesh", "Polygon", [ring]), ("B", "Bihar", "Polygon", [ring]), ("C", "uttar pradesh", "MultiPolygon", [[ring], [ring]])]
    put(tmp_path / "b.json", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n, "state": s}, "geometry": {"type": t, "coordinates": c}} for n, s, t, c in shapes]}))
    got = tables.read_boundaries(spark, str(tmp_path / "b.json"), "name", ("state", "Uttar")).collect()
    assert [r.name for r in got] == ["A", "C", "C"] and got[0].ring[1].lon == 1.0
    put(tmp_path / "api/1.json", json.dumps({"output": {"type": "ok", "message": "", "data": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}]}}))
    put(tmp_path / "api/2.json", json.dumps({"output": {"type": "error", "message": "none"}}))
    assert sorted((r.id, r.name) for r in tables.read_answers(spark, str(tmp_path / "api"), "id: int, name: string").collect()) == [(1, "x"), (2, "y")]
    maps = spark.createDataFrame([({"7": {"name": "Agra", "markets": [{"market_id": 1, "market_name": "m"}]}},)], "markets map<string, struct<name: string, markets: array<struct<market_id: int, market_name: string>>>>")
    assert [tuple(r) for r in tables.market_map(maps).collect()] == [("7", "Agra", 1, "m")]


def test_sinks_and_ingest(spark, tmp_path):
    a = spark.createDataFrame([(1, 2006), (2, 2006)], "k int, year int")
    tables.write_table(a, str(tmp_path / "t"), ("year",))
    tables.write_new(spark.createDataFrame([(2, 2006), (3, 2007)], "k int, year int"), str(tmp_path / "n"), ["k", "year"], spark.read.parquet(str(tmp_path / "t")))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "n")).collect()] == [(3, 2007)]
    tables.write_metadata(spark, str(tmp_path / "m"), rows=2, name="x")
    assert spark.read.json(str(tmp_path / "m")).first().rows == 2
    for n in (1, 2):
        spark.createDataFrame([(n, 0)], "k int, year int").write.parquet(str(tmp_path / f"in/{n}"))
        arrivals.append_available(arrivals.new_rows(spark, str(tmp_path / "in"), "k int, year int"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_headers_quotes_and_encodings(spark, tmp_path):
    """A quoted header with a comma in a name, a byte order mark, and a file that is not UTF-8."""
    put(tmp_path / "A/2010.csv", '﻿"Price Date","odd, name","Modal ""Price"""\n2010-01-02,x,5\n')
    (tmp_path / "B").mkdir()
    (tmp_path / "B/2011.csv").write_bytes("Price Date,Market ID,Modal Price\n2011-01-02,café,7\n".encode("latin-1"))
    put(tmp_path / "C/2012.csv", "Price Date,Market ID,Modal Price\n2012-01-02,thé,8\n")
    heads = {r.path.rsplit("/", 2)[-2]: r.columns for r in tables.heads(spark, str(tmp_path)).collect()}
    assert heads == {"A": ["Price Date", "odd, name", 'Modal "Price"'], "B": ["Price Date", "Market ID", "Modal Price"], "C": ["Price Date", "Market ID", "Modal Price"]}
    (tmp_path / "A/2010.csv").unlink()
    assert sorted((r.district, r.market_id, r.modal_price) for r in tables.read_prices(spark, str(tmp_path)).collect()) == [("B", "café", "7"), ("C", "thé", "8")]


def test_names_of_folders_and_files(spark, tmp_path):
    """Spaces, percent and plus signs, hashes and letters beyond ASCII in paths: found, read and named as they are called."""
    folders = ["Bara Banki", "100% Agra", "A#1", "Kanpur+Dehat", "Zürich ओ", "a%20b"]
    for i, f in enumerate(folders):
        put(tmp_path / f / "2010.csv", f"Price Date,Market ID,Modal Price\n2010-01-0{i + 1},{i},{i}5\n")
    put(tmp_path / "flat one.csv", "date,modal price\n2011-01-01,9\n")
    put(tmp_path / "Bara Banki/2011.csv", "date,modal price\n")
    rows = tables.read_prices(spark, str(tmp_path))
    assert sorted((r.district, r.filename, r.modal_price) for r in rows.collect()) == sorted([(f, "2010.csv", f"{i}5") for i, f in enumerate(folders)] + [("flat one", "flat one.csv", "9")])
    files = tables.listed(spark, str(tmp_path))
    assert {r.district for r in files.collect()} == {*folders, "flat one"}
    assert [(r.district, r.filename) for r in tables.header_only(files, rows).collect()] == [("Bara Banki", "2011.csv")]
    put(tmp_path / "m x/area 2007 #2.csv", "State Name,District Name,Area\nuttar pradesh,Bara Banki,12\n")
    put(tmp_path / "m x/yield 2008.csv", "District Name,Season,Yield\nAgra,Rabi,\"1,234.5\"\n,Rabi,1\n")
    got = tables.read_metric(spark, str(tmp_path / "m x"), "Uttar Pradesh").collect()
    assert sorted((r.unit, r.year, r.district, r.season, r.value) for r in got) == [("area 2007 #2.csv", 2007, "Bara Banki", None, 12.0), ("yield 2008.csv", 2008, "Agra", "Rabi", 1234.5)]
    on_map = tables.read_metric(spark, str(tmp_path / "m x"), "Uttar Pradesh", APY_NAMES).collect()
    assert sorted(r.district for r in on_map) == ["Agra", "Barabanki"]


def test_lines_of_every_encoding(spark, tmp_path):
    for name, code in (("utf", "utf-8"), ("latin", "latin-1"), ("windows", "cp1252")):
        (tmp_path / f"{name}.csv").write_bytes(("date,modal price,market id\n" + f"2010-01-01,1,{'café – “€”' if code != 'latin-1' else 'café'}\n").encode(code))
    assert {r.district: r.market_id for r in tables.read_prices(spark, str(tmp_path)).collect()} == {"utf": "café – “€”", "latin": "café", "windows": "café – “€”"}


def test_layouts_quotes_and_odd_lines(spark, tmp_path):
    put(tmp_path / "a.csv", 'modal price,"market, id",date\r\n"1,5","say ""x""",2010-01-01\r\n\r\n,only,2010-01-02\r\nmodal price,"market, id",date\r\n7\r\n')
    put(tmp_path / "b.csv", "")
    put(tmp_path / "c.csv", "\n\nReported_Date,Mode_x0020_Price\n2010-02-01,8")
    got = sorted(((r.district, r.date, r.modal_price) for r in tables.read_prices(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("a", "2010-01-01", "1,5"), ("a", "2010-01-02", None), ("a", None, "7"), ("c", "2010-02-01", "8")], key=str)
    assert tables.read_prices(spark, str(tmp_path)).columns == ["district", "filename", "market_id", "date", "min_price", "max_price", "modal_price"]
    (tmp_path / "none").mkdir()
    assert tables.read_prices(spark, str(tmp_path / "none")).count() == 0 and tables.read_metric(spark, str(tmp_path / "none"), "x").count() == 0


def test_units_are_written_unless_real(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = lambda *x: spark.createDataFrame(list(x), "district string, year int, value int")
    tables.write_units(rows(("a", 2000, 1), ("b", 2000, 2)), path, ["district", "year"], rows().limit(0))
    tables.write_units(rows(("a", 2000, 9), ("b", 2001, 3)), path, ["district", "year"], spark.read.parquet(path))
    assert sorted((r.district, r.year, r.value) for r in spark.read.parquet(path).collect()) == [("a", 2000, 1), ("b", 2000, 2), ("b", 2001, 3)]
    files = spark.createDataFrame([("a", 1), ("b", 1)], "district string, year int")
    planned = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "district string, year int")
    got = tables.writable(planned, files, files.where("district = 'a'"), ["district", "year"])
    assert sorted(r.district for r in got.collect()) == ["b", "c"]
