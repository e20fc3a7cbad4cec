"""Small helpers that the operators share: lineage cuts, text defaults, graph components, salted joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}
_tables: dict[int, tuple[weakref.ref, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a local session gets a fresh temporary
    folder; on a cluster no folder of one machine would do, so there it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = root or tempfile.mkdtemp(prefix="spark-")
        _folders[app] = f"{root.rstrip('/')}/panelkit-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the folder is scratch
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() gave and that no later job will read."""
    for table in tables:
        made, path = _tables.pop(id(table), (None, ""))
        if made is not None and made() is table:
            _remove(table.sparkSession, path)


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, with the session's Arrow batches at `rows` rows at most: texts are long, and a batch is held twice in a worker and
    in its executor. The setting is the session's, since a plan has none of its own, and it stays; batches of very long
    texts are cut by Spark's own bound on bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return df


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Left join whose hot keys go to several tasks: big is dealt by (keys, salt), small is repeated for each salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root): root is the smallest id that can be reached.

    Every node points at the smallest of itself and its neighbours; the pointers are followed to their ends, which are
    smaller than all around them; then both ends of every link are replaced by these, loops dropped and equal links
    merged. At most half of the nodes are left for the next round, and links only get fewer. Nodes, links and pointers
    stay distributed; only whether any are left reaches the driver. Every join's other side has one row a node, so a
    hub's links can be split over tasks.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not rounds or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        ends = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")))
        moving = True
        while moving:
            further = ends.select(F.col("node").alias("root"), F.col("root").alias("far"))
            after = cut(ends.join(further, "root").select("node", F.col("far").alias("root"), (F.col("root") > F.col("far")).alias("moved")))
            moving = not after.where("moved").isEmpty()
            discard(ends)
            ends = after
        rounds.append(ends)
        at = lambda end: ends.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        moved = links.join(at("a"), "a").join(at("b"), "b").where("a_root <> b_root")
        fewer = cut(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        discard(links)
        links = fewer
    found = rounds[0].select("node", "root")
    for later in rounds[1:]:
        found = found.join(later.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    return found
