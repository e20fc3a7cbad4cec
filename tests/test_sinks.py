"""Named files, and units written once by several writers at a time."""

import threading

import pandas as pd
from pyspark.sql import functions as F

from panelkit.sources import sinks


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "out put")
    rows = spark.createDataFrame([("b", 2, 0.12345678), ("a", 1, -0.5), ("c", 1, None)], "district string, cluster_id int, silhouette double")
    means = spark.createDataFrame([(None, 3, 2.0), (2, 1, 5.0), (1, 2, 0.5)], "cluster_id int, n long, `odd, name` double")
    wide = rows.select("district", F.lit(1.5).alias("f1"))
    for _ in range(2):  # a second run replaces the first one's files
        sinks.write_clusters(folder, rows, means, means.where("cluster_id is not null"), wide, wide.limit(0))
    assert sorted(p.name for p in (tmp_path / "out put").iterdir() if not p.name.startswith(".")) == ["cluster_assignments.csv", "cluster_profiles.csv", "cluster_zscores.csv", "merged_features.csv", "selected_features.csv"]
    got = pd.read_csv(tmp_path / "out put/cluster_assignments.csv")
    assert list(got.columns) == ["district", "cluster_id", "silhouette_score_individual"] and list(got.district) == ["a", "c", "b"] and got.silhouette_score_individual[2] == 0.123457
    got = pd.read_csv(tmp_path / "out put/cluster_profiles.csv")
    assert list(got.cluster) == ["Cluster_1", "Cluster_2", "All Districts"] and list(got["odd, name"]) == [0.5, 5.0, 2.0]
    assert list(pd.read_csv(tmp_path / "out put/cluster_zscores.csv").cluster) == ["Cluster_1", "Cluster_2"]
    assert len(pd.read_csv(tmp_path / "out put/merged_features.csv")) == 0


def test_first_writer_of_a_unit_stays(spark, tmp_path):
    table = sinks.UnitTable(spark, str(tmp_path / "t"), ["district", "year"])
    assert table.read() is None
    rows = lambda *x: spark.createDataFrame(list(x), "district string, year int, value int")
    assert table.write(rows(("a", 1, 1), ("a", 1, 2), ("b", 1, 3))) == 0
    assert table.write(rows(("a", 1, 9), ("c", 1, 4))) == 1
    assert table.write(rows(("a", 1, 7), ("b", 1, 7))) == -1
    assert table.write(rows().limit(0)) == -1
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("c", 1, 4)]


def test_writers_at_the_same_time(spark, tmp_path):
    """Eight writers with units in common: each unit has the rows of exactly one of them, and none is lost."""
    path, errors, numbers = str(tmp_path / "t"), [], []
    start = threading.Barrier(8)

    def work(writer):
        try:
            rows = [(f"d{(writer + k) % 12}", 2000 + y, writer) for k in range(4) for y in range(2) for _ in range(3)]
            df = spark.createDataFrame(rows, "district string, year int, writer int")
            start.wait()
            numbers.append(sinks.UnitTable(spark, path, ["district", "year"]).write(df))
        except Exception as e:  # shown by the test
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    won = [n for n in numbers if n >= 0]
    assert sorted(won) == list(range(len(won)))
    units = sinks.UnitTable(spark, path, ["district", "year"]).read().groupBy("district", "year").agg(F.count("*").alias("n"), F.count_distinct("writer").alias("writers")).collect()
    assert all(r.n == 3 and r.writers == 1 for r in units)
    assert {(r.district, r.year) for r in units} == {(f"d{(w + k) % 12}", 2000 + y) for w in range(8) for k in range(4) for y in range(2)}


def test_only_one_creates(spark, tmp_path):
    folder = sinks.Folder(spark, str(tmp_path / "log"))
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if folder.create("1.json", f"text {i}") else None) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and folder.text("1.json") == f"text {won[0]}" and folder.names() == ["1.json"]
