"""Sinks that take care: single named files of small tables, and a table of units that several writers may add to."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder wherever Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path)) if self.system.exists(self.path) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet, whole or not at all; False if somebody else has written it.

        On one machine a hard link to the finished text is what only one writer can set; elsewhere creating without
        overwriting is, as HDFS and the stores with conditional puts do it.
        """
        self.system.mkdirs(self.path)
        if self.system.getUri().getScheme() == "file":
            folder = self.path.toUri().getPath()
            made = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(made, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(made, os.path.join(folder, name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
        try:
            stream = self.system.create(self.at(name), False)
        except Exception as e:
            if self.system.exists(self.at(name)):
                return False
            raise e
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        return True


def write_file(df: DataFrame, folder: str, name: str) -> None:
    """A small table as one CSV file of that name, with a header and in df's order; an existing file is replaced at the end."""
    spark = df.sparkSession
    to = Folder(spark, folder)
    staged = f"_{name}-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", "true").csv(str(to.at(staged)))
    part = next((n for n in Folder(spark, str(to.at(staged))).names() if n.startswith("part-")), None)
    if part is None:  # no rows: the header alone
        header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns)
        Folder(spark, str(to.at(staged))).create("part-none", header + "\n")
        part = "part-none"
    to.system.delete(to.at(name), False)
    to.system.rename(to.jvm.org.apache.hadoop.fs.Path(to.at(staged), part), to.at(name))
    to.system.delete(to.at(staged), True)


def write_clusters(folder: str, assignments: DataFrame, profiles: DataFrame, zscores: DataFrame, selected: DataFrame, merged: DataFrame, entity: str = "district") -> None:
    """The clusters' tables as files called by what they hold.

    assignments: entity, cluster_id, silhouette. profiles: cluster_id (null: all rows) and means; zscores: cluster_id and
    scores. Clusters are named Cluster_1, ..., the whole All Districts.
    """
    score = F.round("silhouette", 6).alias("silhouette_score_individual")
    write_file(assignments.select(entity, "cluster_id", score).orderBy("cluster_id", entity), folder, "cluster_assignments.csv")
    label = F.coalesce(F.concat(F.lit("Cluster_"), F.col("cluster_id").cast("string")), F.lit("All Districts")).alias("cluster")
    for table, name in ((profiles, "cluster_profiles.csv"), (zscores, "cluster_zscores.csv")):
        write_file(table.orderBy(F.col("cluster_id").asc_nulls_last()).select(label, *[c for c in table.columns if c not in ("cluster_id", "n")]), folder, name)
    write_file(selected.orderBy(entity), folder, "selected_features.csv")
    write_file(merged.orderBy(entity), folder, "merged_features.csv")


class UnitTable:
    """A table whose units (values of `keys`) are written once, by whoever comes first, with any number of writers at a time.

    Rows are staged in a folder of their own. What counts is a log of numbered files, each naming a folder: a writer
    leaves out units that the log's folders hold, stages the others and tries to create the next number. If somebody
    else has it, the writer looks at what was added, takes those units out and tries again. Readers see logged folders
    only, so what a stopped writer has left behind is never seen.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.log = Folder(spark, f"{self.path}/_log")

    def entries(self) -> list[dict]:
        return [json.loads(self.log.text(n)) for n in self.log.names() if n.endswith(".json")]

    def read(self, entries: list[dict] | None = None) -> DataFrame | None:
        """The rows of all logged folders; None if there is none yet."""
        entries = self.entries() if entries is None else entries
        folders = [f"{self.path}/{e['folder']}" for e in entries]
        return self.spark.read.schema(entries[0]["schema"]).parquet(*folders) if folders else None

    def write(self, df: DataFrame, tries: int = 20) -> int:
        """Add the units of df that are not there; the number of the log's entry that did, or -1 if all were there."""
        rows = df
        for _ in range(tries):
            entries = self.entries()
            there = self.read(entries)
            if there is not None:
                rows = rows.join(there.select(*self.keys).distinct(), self.keys, "left_anti").select(*there.columns)
            folder = f"_staged/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
            if staged.isEmpty():
                self._drop(folder)
                return -1
            schema = entries[0]["schema"] if entries else ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
            if self.log.create(f"{len(entries):012d}.json", json.dumps({"folder": folder, "schema": schema})):
                return len(entries)
            rows = staged  # what was staged is what is left to try; its folder stays until the writer is done with it
        raise RuntimeError(f"somebody else was faster {tries} times")

    def _drop(self, folder: str) -> None:
        self.log.system.delete(self.log.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)
