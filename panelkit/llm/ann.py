"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 9).

Each of TABLES tables hashes a vector by floor((a . x + b) / w) for a few Gaussian a: a bucket. A query visits buckets
in the order of their estimated chance to hold a near vector: along a projection, a vector at distance R from the query
is normal around a point between the query and the mean (spread and R are measured on a bounded sample), so a bucket's
chance is a product of normal masses, and the visits stop when their sum reaches the success asked for. What the tables
find is merged, and distances are exact, in double precision, on the original vectors.

Equal vectors are one entry with its smallest ids (more than k can never be asked for), so copies cost nothing. Buckets
of over `block` entries are split over several groups, to which their visits are repeated. A group's entries are held
by one task, visits stream past them, and a task keeps only its best k for each query. There are only so many projections
that most sampled queries reach their success in `most` visits a table. Queries that do not, and those that found fewer
than k, are compared with every entry, dealt into blocks by hash. Cells too far out to be tried (CELLS from the middle, or
of a mass under 1e-4) count as not visited: what they hold lowers a query's sum and so may send it to that exact way.
Whatever does not depend on the sample - index, visits, distances - covers all rows.

Defined results: rows take no part whose id or vector is null, or whose vector is zero or empty, holds null or
non-finite components, or has another length than most; a repeated (id, vector) counts once; ties, of copies or not, go
to the smaller id;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, salted_left_join

TABLES = 2
CELLS = 6


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct (id, v) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (most[0]["d"] if most else 0)).distinct()


class Hashing:
    """Projections fitted to a sample: the cell width, and how a near vector's projection spreads around the query's."""

    def __init__(self, sample: np.ndarray, n: int, k: int, success: float, occupancy: int, seed: int = 7, most: int = 20_000) -> None:
        rng = np.random.RandomState(seed)
        dims = sample.shape[1]
        # a query of a table of a few k entries has to see most of them; every other table is hashed
        self.m = min(12, max(1, round(math.log(max(1.0, n / occupancy), 3)))) if n > 8 * k else 0
        self.a = rng.normal(size=(TABLES, self.m, dims))
        self.b = rng.uniform(size=(TABLES, self.m))
        self.most = most
        self.each = 1 - (1 - success) ** (1 / TABLES)
        if self.m:
            few = sample[:200]
            d2 = np.maximum(0, (few**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * few @ sample.T)
            rank = min(d2.shape[1] - 1, max(1, round(k * len(sample) / n)))
            r2 = float(np.quantile(np.partition(d2, rank, axis=1)[:, rank], 0.75))
            projected = np.einsum("nd,tmd->tmn", sample, self.a)
            self.mean = projected.mean(axis=2)
            variance = np.maximum(projected.var(axis=2), 1e-12)
            self.rho = np.clip(1 - r2 / (2 * variance), 0, 1)
            self.sd = np.sqrt(np.maximum(variance * (1 - self.rho**2), 1e-12))
            self.w = 1.2 * np.sqrt(variance)
            self.shorten(few[:20])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n x TABLES) bucket numbers."""
        if not self.m:
            return np.zeros((len(x), TABLES), dtype=np.int64)
        y = np.einsum("nd,tmd->ntm", x, self.a) / self.w + self.b
        return self._numbers(np.floor(y).astype(np.int64))

    @staticmethod
    def _numbers(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], dtype=np.int64)
        for i in range(cells.shape[-1]):
            out = out * np.int64(1_000_003) + cells[..., i]
        return out

    def _ranked(self, q: np.ndarray, t: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each projection of table t: the best `most` (chances, cells) of the projections so far, best first."""
        from statistics import NormalDist

        cdf = NormalDist().cdf
        chance, cells = np.ones(1), np.zeros((1, 0), dtype=np.int64)
        for i in range(self.m):
            y = float(self.a[t, i] @ q)
            centre = self.mean[t, i] + self.rho[t, i] * (y - self.mean[t, i])
            middle = math.floor(centre / self.w[t, i] + self.b[t, i])
            near = np.arange(middle - CELLS, middle + CELLS + 1)
            edge = [cdf(((c - self.b[t, i]) * self.w[t, i] - centre) / self.sd[t, i]) for c in [*near, near[-1] + 1]]
            p = np.diff(edge)
            near, p = near[p > 1e-4], p[p > 1e-4]
            chance = (chance[:, None] * p[None]).ravel()
            cells = np.concatenate([np.repeat(cells, len(near), axis=0), np.tile(near, len(cells))[:, None]], axis=1)
            best = np.argsort(-chance, kind="stable")[:most]
            chance, cells = chance[best], cells[best]
            yield chance, cells

    def shorten(self, queries: np.ndarray, share: float = 0.9) -> None:
        """Keep only so many projections, one at least, that `share` of the queries reach their success in every table."""
        if not self.m or not len(queries):
            return
        least = np.array([np.min([[chance.sum() for chance, _ in self._ranked(q, t, self.most)] for t in range(TABLES)], axis=0) for q in queries])
        good = np.flatnonzero((least >= self.each).mean(axis=0) >= share)
        self.m = int(good[-1]) + 1 if len(good) else 1
        self.a, self.b, self.mean, self.rho, self.sd, self.w = (x[:, : self.m] for x in (self.a, self.b, self.mean, self.rho, self.sd, self.w))

    def visits(self, q: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(table, buckets in the order of estimated success) for one query; none if `most` buckets of a table don't reach it."""
        if not self.m:
            return [(0, np.zeros(1, dtype=np.int64))]
        out = []
        for t in range(TABLES):
            *_, (chance, cells) = self._ranked(q, t, self.most)
            sums = np.cumsum(chance)
            if not len(sums) or sums[-1] < self.each:
                return []
            out.append((t, self._numbers(cells[: int(np.searchsorted(sums, self.each)) + 1])))
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _indexed(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            numbers = hashing.buckets(_vectors(batch.column("v")))
            for t in range(TABLES if hashing.m else 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, dtype=np.int32)), pa.array(numbers[:, t]), batch.column("vid"), batch.column("v")], ["t", "bucket", "vid", "v"])


def _visited(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, q in enumerate(_vectors(batch.column("v"))):
            row = batch.slice(r, 1)
            for t, numbers in hashing.visits(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), t, dtype=np.int32)), pa.array(numbers), *(row.column(c).take(pa.array(np.zeros(len(numbers), dtype=np.int64))) for c in ("vid", "v"))], ["t", "bucket", "vid", "v"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int, hold: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, entries before visits: the best k entries of each query that the task has seen."""
    group, entries, numbers, x = None, [], None, None
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        q = np.repeat(np.fromiter(best, np.int64, len(best)), [len(d) for d, _ in best.values()])
        out = pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([c for _, c in best.values()])), pa.array(np.concatenate([d for d, _ in best.values()]))], ["qvid", "cvid", "score"])
        best.clear()
        return out

    for batch in batches:
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("t", "bucket", "salt", "kind")], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if (own := tuple(key[a, :3].tolist())) != group:
                group, entries, x = own, [], None
            part = batch.slice(a, b - a)
            if key[a, 3] == 0:
                entries.append(part)
                continue
            if not entries:
                continue
            if x is None:
                x = np.concatenate([_vectors(p.column("v")) for p in entries])
                numbers = np.concatenate([np.asarray(p.column("vid")) for p in entries])
                norm = (x**2).sum(axis=1)
            qs, q = np.asarray(part.column("vid")), _vectors(part.column("v"))
            for begin in range(0, len(qs), 256):
                some = q[begin : begin + 256]
                rough = np.maximum(0, norm[None] + (some**2).sum(axis=1)[:, None] - 2 * some @ x.T)
                last = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                for r in range(len(some)):
                    near = np.flatnonzero(rough[r] <= last[r] + 1e-9 * (1 + last[r] + norm.max()))
                    d = np.sqrt(((x[near] - some[r]) ** 2).sum(axis=1))
                    c = numbers[near]
                    if (old := best.get(int(qs[begin + r]))) is not None:
                        c, first = np.unique(np.concatenate([old[1], c]), return_index=True)
                        d = np.concatenate([old[0], d])[first]
                    keep = np.lexsort((c, d))[: k]
                    best[int(qs[begin + r])] = d[keep], c[keep]
            if len(best) > hold:
                yield flush()
    if best:
        yield flush()


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", success: float = 0.97, occupancy: int = 200, block: int = 4096, sample_rows: int = 4000, most: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for whose id `is_query` (a function of a Column) holds.

    sample_rows bounds the rows on which R and the spread of projections are measured. success: the share of true
    neighbours that the visits are to reach. most: buckets of a table that a query may visit to reach it.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors, vec_id, embedding))
    own = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1)  # limited before the shuffle, too
    # a global sort's partitions are in order, so vid rises with an entry's smallest id, and ties by vid are ties by that
    named = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy(F.get("ids", F.lit(0)))
    entries = cut(named.select(F.monotonically_increasing_id().alias("vid"), "v", "ids"))
    queries = cut(rows.where(is_query(F.col("id"))).join(entries.select("v", "vid"), "v").select(F.col("id").alias("query_id"), "vid"))
    asked = entries.join(queries.select("vid").distinct(), "vid", "left_semi").select("vid", "v")

    n = entries.count()
    sample = entries.where(F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, sample_rows / max(n, 1)))).select("v").limit(2 * sample_rows).collect()
    hashing = Hashing(np.array([r["v"] for r in sample], dtype=np.float64) if sample else np.zeros((0, 1)), n, k, success, occupancy, most=most)

    index = cut(entries.mapInArrow(lambda b: _indexed(b, hashing), "t int, bucket bigint, vid bigint, v array<double>"))
    crowded = cut(index.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).select("t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("p")))
    spread = salted_left_join(index, crowded, ["t", "bucket"], F.col("vid")).withColumn("salt", F.pmod(F.xxhash64("vid"), F.coalesce("p", F.lit(1))).cast("int")).drop("p")

    def found(entries: DataFrame, visits: DataFrame) -> DataFrame:
        both = entries.withColumn("kind", F.lit(0)).unionByName(visits.withColumn("kind", F.lit(1)))
        dealt = both.repartition("t", "bucket", "salt").sortWithinPartitions("t", "bucket", "salt", "kind")
        return dealt.mapInArrow(lambda b: _nearest(b, k + 1), "qvid bigint, cvid bigint, score double")

    visits = asked.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(lambda b: _visited(b, hashing), "t int, bucket bigint, vid bigint, v array<double>")
    to = salted_left_join(visits, crowded, ["t", "bucket"], F.col("vid")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("p", F.lit(1)) - 1))).drop("p")
    hits = cut(found(spread, to))
    enough = hits.groupBy("qvid").agg(F.count_distinct("cvid").alias("n")).where(F.col("n") >= min(k + 1, n))
    starved = cut(asked.join(enough, F.col("vid") == F.col("qvid"), "left_anti"))
    if not starved.isEmpty():
        blocks = math.ceil(n / block)
        at = lambda bucket: (F.lit(0).alias("t"), bucket.alias("bucket"), "vid", "v", F.lit(0).alias("salt"))
        everywhere = starved.select(*at(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
        hits = hits.unionByName(cut(found(entries.select(*at(F.pmod(F.xxhash64("vid"), F.lit(blocks)))), everywhere)))

    best = hits.distinct().withColumn("n", F.row_number().over(Window.partitionBy("qvid").orderBy("score", "cvid"))).where(F.col("n") <= k + 1)
    itself = asked.select(F.col("vid").alias("qvid"), F.col("vid").alias("cvid"), F.lit(0.0).alias("score"))
    answers = best.select("qvid", "cvid", "score").union(itself).distinct().join(entries.select(F.col("vid").alias("cvid"), "ids"), "cvid")
    pairs = answers.select("qvid", F.explode(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("id")))).alias("x"))
    lists = pairs.groupBy("qvid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # (k + 2) * (k + 1) pairs at most
    out = queries.join(lists, queries["vid"] == lists["qvid"]).select("query_id", F.slice(F.filter("x", lambda x: x["id"] != F.col("query_id")), 1, k).alias("x"))
    return out.select("query_id", F.posexplode("x").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
