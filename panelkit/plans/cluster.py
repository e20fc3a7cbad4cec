"""From a wide feature table to clusters and their profiles: selection, scaling, PCA, Ward, silhouette, profiles.

Per-feature work (variation, correlation, scaling, means) is Spark aggregation over all rows. Ward linkage and
silhouettes need every pair of rows: rows are dealt into blocks, and a task holds two blocks. Work grows with the square
of the rows, so they are for entities (districts, shops), not for events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.stats import ratio
from ..operators import quantiles


def merge(anchor: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Left joins onto anchor; a key that is not unique in another table is an error, so rows cannot multiply."""
    out = anchor
    for o in others:
        if not o.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique")
        clash = [c for c in o.columns if c != key and c in out.columns]
        out = out.join(o.withColumnsRenamed({c: f"{c}_right" for c in clash}), key, "left")
    return out


def missing_fractions(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, missing: share of nulls."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in features]).unpivot([], features, "feature", "missing")


def drop_missing(df: DataFrame, features: list[str], most: float = 0.20) -> list[str]:
    rates = {r["feature"]: r["missing"] for r in missing_fractions(df, features).collect()}  # one row a feature
    return [c for c in features if (rates[c] or 0) <= most]


def flag_rows(df: DataFrame, features: list[str], most: float = 0.30) -> DataFrame:
    """df with missing_fraction and flagged; nothing is dropped."""
    share = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in features]) / len(features)
    return df.withColumn("missing_fraction", share).withColumn("flagged", F.col("missing_fraction") > most)


def impute_medians(df: DataFrame, features: list[str]) -> DataFrame:
    medians = quantiles.of_columns(df, features, 0.5)
    return df.fillna(medians) if medians else df


def variation(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, cv: deviation over |mean|; with mean 0: 0 if there is no deviation, else infinite."""
    def cv(c: str) -> Column:
        mean, sd = F.avg(c), F.stddev_samp(c)
        return F.when(mean != 0, sd / F.abs(mean)).when(sd == 0, 0.0).otherwise(F.lit(float("inf"))).alias(c)

    return df.agg(*[cv(c) for c in features]).unpivot([], features, "feature", "cv")


def varied(df: DataFrame, features: list[str], least: float = 0.01) -> list[str]:
    cv = {r["feature"]: r["cv"] for r in variation(df, features).collect()}
    return [c for c in features if cv[c] is not None and cv[c] >= least]


def _masked_sums(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each pair (i, j): rows that have both, and over these the sums of x_i, x_i squared and x_i x_j, of values less `shift`."""
    d = len(shift)
    sums = np.zeros((4, d, d))
    for batch in batches:
        x = np.column_stack([np.asarray(pc.fill_null(c, np.nan), dtype=np.float64) for c in batch.columns]) - shift
        there = np.isfinite(x)
        x, there = np.where(there, x, 0.0), there.astype(np.float64)
        sums += there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
    i, j = np.indices((d, d)).reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(s.ravel()) for s in sums]], ["i", "j", "n", "x", "xx", "xy"])


def correlations(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson correlation matrix, each pair over the rows that have both values (null, NaN and infinite ones count as missing).

    NaN where a pair has fewer than two such rows, or no deviation among them. Each task adds up four matrices of its
    rows, which Spark adds up pair by pair: work and results grow with features squared, never with rows in one place.
    """
    names = [F.col(c).cast("double") for c in features]
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    centre = df.agg(*[F.avg(finite(x)).alias(c) for x, c in zip(names, features)]).first()
    shift = np.array([x if x is not None else 0.0 for x in centre])  # sums around the mean do not cancel
    rows = df.select(*[x.alias(f"f{k}") for k, x in enumerate(names)])
    parts = rows.mapInArrow(lambda b: _masked_sums(b, shift), "i int, j int, n double, x double, xx double, xy double")
    totals = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")]).collect()  # features squared
    n, x, xx, xy = (np.zeros((len(features), len(features))) for _ in range(4))
    for r in totals:
        for m, c in ((n, "n"), (x, "x"), (xx, "xx"), (xy, "xy")):
            m[r["i"], r["j"]] = r[c]
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = xx - x * x / n  # of i, among the rows that have j too
        spread[spread <= 1e-13 * xx] = 0.0
        r = (xy - x * x.T / n) / np.sqrt(spread * spread.T)
    return np.where((n >= 2) & (spread > 0) & (spread.T > 0), np.clip(r, -1, 1), np.nan)


def uncorrelated(df: DataFrame, features: list[str], most: float = 0.95) -> list[str]:
    """Features in alphabetical order, each dropped if an earlier kept one correlates above `most` with it."""
    names = sorted(features)
    r = np.abs(correlations(df, names))
    kept: list[int] = []
    for j in range(len(names)):
        if not any(r[i, j] > most for i in kept):
            kept.append(j)
    return [names[i] for i in kept]


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with mean 0 and population deviation 1; those without deviation become 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    row = stats.first()
    if row is None or row[0] is None:
        return df
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in features})


def principal(df: DataFrame, features: list[str], share: float = 0.90) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """df with array `pc`, the loadings (features x components) and explained shares of the fewest components that reach `share`.

    Each component's sign makes its largest loading positive.
    """
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(df)
    whole = PCA(k=len(features), inputCol="_v", outputCol="_pc").fit(vectors)
    explained = np.asarray(whole.explainedVariance)
    m = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    pc = whole.pc.toArray()[:, :m]
    sign = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(m)])
    out = whole.transform(vectors).withColumn("pc", F.slice(vector_to_array("_pc"), 1, m)).drop("_v", "_pc")
    signs = F.array(*[F.lit(float(s)) for s in sign])
    return out.withColumn("pc", F.zip_with("pc", signs, lambda a, b: a * b)), pc * sign, explained[:m]


def loadings_table(spark: SparkSession, features: list[str], loadings: np.ndarray) -> DataFrame:
    """feature, component (PC1, ...), loading: what principal() gives, as a table that can be written and read again."""
    rows = [(c, f"PC{j + 1}", float(loadings[i, j])) for i, c in enumerate(features) for j in range(loadings.shape[1])]
    return spark.createDataFrame(rows, "feature string, component string, loading double")


def strongest_loadings(table: DataFrame, k: int = 5) -> DataFrame:
    """The k features of each component with the largest |loading| (ties by name), with rank."""
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scaler_table(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean, deviation (population's): what standardise() uses, as a table that can be written and read again."""
    both = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")).alias(c) for c in features])
    return both.unpivot([], features, "feature", "x").select("feature", "x.mean", "x.deviation")


def project(df: DataFrame, scaler: DataFrame, loadings: DataFrame) -> DataFrame:
    """df with array `pc` by a stored scaler and stored loadings: new rows in the components of an earlier fit.

    Both tables have one row a feature (and component), whatever the rows of df, so they are read into the plan.
    """
    scale = {r["feature"]: (r["mean"], r["deviation"] or 1.0) for r in scaler.collect()}
    by: dict[str, list[Column]] = {}
    for r in loadings.collect():
        mean, deviation = scale[r["feature"]]
        by.setdefault(r["component"], []).append((F.col(r["feature"]) - F.lit(mean)) / F.lit(deviation) * F.lit(r["loading"]))
    names = sorted(by, key=lambda c: int(c[2:]))
    return df.withColumn("pc", F.array(*[reduce(lambda a, b: a + b, by[c]) for c in names]))


def small_clusters(assigned: DataFrame, least: int = 3, cluster: str = "cluster") -> DataFrame:
    """cluster, n of the clusters with fewer than `least` members: a profile of so few means little."""
    return assigned.groupBy(cluster).agg(F.count("*").alias("n")).where(F.col("n") < least)


def on_map(places: DataFrame, assigned: DataFrame, place: str, entity: str, renamed: dict[str, str]) -> DataFrame:
    """places (a map's shapes) inner-joined with the clusters of entities, whose names on the map may differ."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]), F.col(entity)), F.col(entity)) if renamed else F.col(entity)
    return places.join(assigned.withColumn(place, name), place)


def ward_tree(x: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Merges (left, right, height, size) of Ward's method on Euclidean distances (Lance-Williams updates).

    size: how many rows each of x, their mean, stands for (one if not given).
    """
    n = len(x)
    size = np.ones(n) if size is None else np.array(size, dtype=float)
    d = sum((np.square(c[:, None] - c[None]) for c in x.T), np.zeros((n, n))) * (2 * size[:, None] * size / (size[:, None] + size))
    np.fill_diagonal(d, np.inf)
    name, out = np.arange(n), np.zeros((max(n - 1, 0), 4))
    alive = np.ones(n, dtype=bool)
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        others = alive.copy()
        others[[i, j]] = False
        total = size[i] + size[j] + size
        merged = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / total
        out[step] = min(name[i], name[j]), max(name[i], name[j]), np.sqrt(d[i, j]), size[i] + size[j]
        d[i], d[:, i] = np.where(others, merged, np.inf), np.where(others, merged, np.inf)
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i], alive[j] = n + step, False
    return out


def cut_tree(tree: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of the tree's k clusters, numbered by their first member."""
    n = len(tree) + 1
    group = {i: [i] for i in range(n)}
    for step in range(n - k):
        group[n + step] = group.pop(int(tree[step, 0])) + group.pop(int(tree[step, 1]))
    labels = np.zeros(n, dtype=int)
    for label, members in enumerate(sorted(group.values(), key=min), start=1):
        labels[members] = label
    return labels


def dendrogram_k(tree: np.ndarray, last: int = 10) -> int:
    """Clusters at the sharpest bend of the last merge heights, from 2 to 10."""
    heights = tree[-last:, 2]
    bend = np.diff(heights, 2)[::-1]
    return int(np.clip(bend.argmax() + 2, 2, 10)) if len(bend) else 2


#: Numbers in the vectors of a block, and distances, that a task holds at once.
HELD = 1 << 21


def _pairs_of_blocks(df: DataFrame, spread: Column, n: int, block: int) -> DataFrame:
    """df's rows, n in all, dealt into blocks by hash and repeated for each unordered pair (_i, _j) of blocks; _b is the row's."""
    p = max(1, math.ceil(n / block))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(spread), F.lit(p)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    return dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o")


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are there, without a null in them, and these as rows."""
    lists = column.combine_chunks()
    there, values = np.asarray(lists.is_valid()), lists.flatten()
    owner = np.repeat(np.flatnonzero(there), pc.list_value_length(lists).drop_null().to_numpy(zero_copy_only=False))
    known = there.copy()
    known[owner[np.asarray(values.is_null())]] = False
    x = np.asarray(values.to_numpy(zero_copy_only=False), dtype=float).reshape(int(there.sum()), -1 if there.any() else 0)
    return known, x[known[there]]


def _squares(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances of some rows of x to all of y)."""
    few = x.shape[1] <= 8
    step = max(1, HELD // max(1, len(y) if few else y.size))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        if few:
            yield a, sum((np.square(p[:, None] - q) for p, q in zip(part.T, y.T)), np.zeros((len(part), len(y))))
        else:
            yield a, ((part[:, None] - y) ** 2).sum(axis=2)


def _distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of some rows of x to all of y): by products, where these lose nothing.

    |x|^2 + |y|^2 - 2xy has an error of some last places of |x|^2 + |y|^2. What is not 1e-5 of that at least is computed
    again by differences, so distances are right to ten digits; narrow vectors, and ones of huge or no numbers, all are.
    """
    if x.shape[1] <= 8 or not max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e100:
        for a, d in _squares(x, y):
            yield a, np.sqrt(d, out=d)
        return
    middle = y.mean(axis=0)
    p, q = x - middle, y - middle
    pp, qq = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
    step, some = max(1, HELD // len(y)), max(1, HELD // x.shape[1])
    for a in range(0, len(x), step):
        least = pp[a : a + step, None] + qq
        d = p[a : a + step] @ q.T
        d *= -2
        d += least
        least *= 1e-5
        near = np.flatnonzero(d < least)
        for k in range(0, len(near), some):
            r, c = np.divmod(near[k : k + some], len(y))
            d[r, c] = ((x[a + r] - y[c]) ** 2).sum(axis=1)
        yield a, np.sqrt(d, out=d)


def _tie_keys(c: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A number for each pair, the same from both sides."""
    x = np.minimum(c, other).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(c, other).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _nearest(t: pa.Table) -> pa.Table:
    """Each cluster's nearest one in a pair of blocks, by Ward's squared height, then by a hash of the pair.

    Ties by number would send all to the same one, and one pair of them would merge in a round.
    """
    c, size, (_, x) = t["c"].to_numpy(), t["size"].to_numpy(), _vectors(t["v"])
    b, i, j = t["_b"].to_numpy(), t["_i"][0].as_py(), t["_j"][0].as_py()
    one, two = np.flatnonzero(b == i), np.flatnonzero(b == j)
    out = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))]

    def least(d: np.ndarray, rows: np.ndarray, met: np.ndarray) -> None:
        cost = d.min(axis=1)
        r, m = np.nonzero(d == cost[:, None])
        r, m = r[cost[r] < np.inf], m[cost[r] < np.inf]
        key = _tie_keys(c[rows[r]], c[met[m]])
        order = np.lexsort((c[met[m]], key, r))
        order = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])] if len(r) else order
        out.append((c[rows[r[order]]], cost[r[order]], key[order], c[met[m[order]]]))

    if len(one) and len(two):
        for a, d in _squares(x[one], x[two]):
            some = one[a : a + len(d)]
            d *= 2 * size[some][:, None] * size[two] / (size[some][:, None] + size[two])
            if i == j:
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            least(d, some, two)
            if i != j:
                least(d.T, two, some)
    return pa.table([np.concatenate(x) for x in zip(*out)], ["c", "cost", "key", "other"])


def _blocked_ward(rows: DataFrame, local: int, block: int) -> np.ndarray:
    """All merges (a, b, squared height), one less than rows (c, v); a cluster is called by its smallest c.

    Rows of one vector are merged first, at height 0. Ward's method is reducible: clusters that are each other's nearest
    merge in every order. So each round merges all such pairs; the last `local` clusters are merged by the driver.
    """
    state = cut(rows.groupBy("v").agg(F.min("c").alias("c"), F.count("*").cast("double").alias("size")).select("c", "size", "v"))
    same = rows.join(state.select(F.col("c").alias("first"), "v"), "v").where("c <> first").select("first", "c").toPandas()
    merges = [np.column_stack([same[["first", "c"]].to_numpy(dtype=float), np.zeros(len(same))])]
    n = state.count()
    while n > local:
        near = _pairs_of_blocks(state, F.col("c"), n, block).groupBy("_i", "_j").applyInArrow(_nearest, "c bigint, cost double, key bigint, other bigint")
        best = cut(near.groupBy("c").agg(F.min(F.struct("cost", "key", "other")).alias("m")).select("c", "m.cost", "m.other"))
        mutual = cut(best.join(best.select(F.col("c").alias("other"), F.col("other").alias("c")), ["c", "other"]).where("c < other"))
        some = mutual.toPandas()
        merges.append(some[["c", "other", "cost"]].to_numpy(dtype=float))
        n -= len(some)
        into = state.join(mutual.select(F.col("other").alias("c"), F.col("c").alias("a")), "c", "left")
        both = into.groupBy(F.coalesce("a", "c").alias("c")).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("c", "size", "v"))).alias("x"))  # one or two
        one, two = F.get("x", F.lit(0)), F.get("x", F.lit(1))
        mean = F.zip_with(one["v"], two["v"], lambda p, q: (one["size"] * p + two["size"] * q) / (one["size"] + two["size"]))
        state = cut(both.select("c", "size", F.when(F.size("x") > 1, mean).otherwise(one["v"]).alias("v")))
    rest = state.orderBy("c").collect()  # `local` rows at most
    tree = ward_tree(np.array([r["v"] for r in rest], dtype=float), np.array([r["size"] for r in rest]))
    name = [r["c"] for r in rest]
    for left, right, height, _ in tree:
        a, b = sorted((name[int(left)], name[int(right)]))
        merges.append(np.array([[a, b, height**2]], dtype=float))
        name.append(a)
    return np.concatenate(merges)


def _labels(n: int, merges: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k of rows 0..n-1 after all but the k - 1 highest merges, numbered by their first member."""
    to = list(range(n))

    def root(i: int) -> int:
        while to[i] != i:
            to[i] = i = to[to[i]]
        return i

    for a, b in merges[np.argsort(merges[:, 2], kind="stable")[: n - k], :2].astype(int):
        a, b = sorted((root(a), root(b)))
        to[b] = a
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1] + 1


def ward(df: DataFrame, key: str, vector: str, ks: list[int], most_rows: int | None = None, local: int = 2000, block: int = 2048) -> DataFrame:
    """key, k, cluster for each k of ks, rows taken in order of key.

    most_rows: refuse more rows, if given. local: rows that one task links; more are linked in blocks of `block`, and the
    driver holds the tree, three numbers a row.
    """
    n = df.count()
    if most_rows is not None and n > most_rows:
        raise ValueError(f"Ward linkage of {n} rows; most_rows is {most_rows}")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        tree = ward_tree(np.array(group[vector].tolist(), dtype=float))
        return pd.concat([pd.DataFrame({key: group[key], "k": k, "cluster": cut_tree(tree, min(k, len(group)))}) for k in ks])

    if n <= local:
        return df.select(key, vector, F.lit(0).alias("_one")).groupBy("_one").applyInPandas(fit, f"`{key}` {dict(df.dtypes)[key]}, k int, cluster int")
    # numbers rise with the key: a global sort's partitions are in order
    rows = cut(df.select(F.col(key).alias("_k"), F.col(vector).alias("v")).orderBy("_k").select("_k", "v", F.monotonically_increasing_id().alias("c")))
    c = np.sort(rows.select("c").toPandas()["c"].to_numpy())
    merges = _blocked_ward(rows, local, block)
    merges[:, :2] = np.searchsorted(c, merges[:, :2])
    labels = df.sparkSession.createDataFrame(pd.concat([pd.DataFrame({"c": c, "k": k, "cluster": _labels(n, merges, min(k, n))}) for k in ks]), "c bigint, k int, cluster int")
    return rows.join(labels, "c").select(F.col("_k").alias(key), "k", "cluster")


def _summed(t: pa.Table) -> pa.Table:
    """Sums and counts of the distances of each row of a pair of blocks to the other rows' clusters; null vectors have no distances."""
    known, x = _vectors(t["_v"])
    place = np.cumsum(known) - 1
    codes = t["_c"].combine_chunks().dictionary_encode(null_encoding="encode")
    code = codes.indices.to_numpy()
    b, i, j = t["_b"].to_numpy(), t["_i"][0].as_py(), t["_j"][0].as_py()
    one, two = (rows[np.argsort(code[rows], kind="stable")] for rows in (np.flatnonzero(b == i), np.flatnonzero(b == j)))
    kinds, n = zip(*(np.unique(code[rows], return_counts=True) for rows in (one, two)))
    far = [np.full((len(one), len(kinds[1])), np.nan), np.full((len(two), len(kinds[0])), np.nan)]
    left, right = one[known[one]], two[known[two]]
    if len(left) and len(right):
        of_left, of_right = np.unique(code[left]), np.unique(code[right])
        begin = np.searchsorted(code[right], of_right)
        rows, columns = np.zeros((len(left), len(of_right))), np.zeros((len(of_left), len(right)))
        for a, d in _distances(x[place[left]], x[place[right]]):
            rows[a : a + len(d)] = np.add.reduceat(d, begin, axis=1)
            if i != j:
                some, first = np.unique(code[left[a : a + len(d)]], return_index=True)
                columns[np.searchsorted(of_left, some)] += np.add.reduceat(d, first, axis=0)
        far[0][np.ix_(np.flatnonzero(known[one]), np.searchsorted(kinds[1], of_right))] = rows
        far[1][np.ix_(np.flatnonzero(known[two]), np.searchsorted(kinds[0], of_left))] = columns.T
    parts = [pa.table([t["_k"][:0], t["_c"][:0], t["_c"][:0], pa.array([], pa.float64()), pa.array([], pa.int64())], ["_k", "_c", "_c2", "d", "n"])]
    for rows, side in ((one, 0), (two, 1))[: 1 if i == j else 2]:
        met, often, sums = kinds[1 - side], n[1 - side], far[side].ravel()
        each = pa.array(np.repeat(rows, len(met)))
        other = codes.dictionary.take(pa.array(np.tile(met, len(rows))))
        parts.append(pa.table([t["_k"].take(each), t["_c"].take(each), other, pa.array(sums, mask=np.isnan(sums)), pa.array(np.tile(often, len(rows)))], ["_k", "_c", "_c2", "d", "n"]))
    return pa.concat_tables(parts)


def silhouettes(df: DataFrame, key: str, vector: str, cluster: str = "cluster", block: int | None = None, most_rows: int | None = None) -> DataFrame:
    """key, cluster, silhouette by Euclidean distances (0 for a cluster of one).

    All rows meet all rows, as the measure demands: in pairs of blocks of `block` rows, whose distances are summed by (row,
    cluster) before the shuffle. That is work by the square of the rows, and a shuffle of the rows times the number of
    blocks: unless given, a block is a twelfth of the rows, 2,048 at least, and HELD numbers at most. most_rows: refuse more
    rows, if given.
    """
    n = df.count()
    if most_rows is not None and n > most_rows:
        raise ValueError(f"{n} rows are more than {most_rows}: silhouettes compare all pairs")
    rows = df.select(F.col(key).alias("_k"), F.col(vector).alias("_v"), F.col(cluster).alias("_c"))
    kinds = dict(rows.dtypes)
    if block is None:
        width = rows.agg(F.max(F.size("_v"))).first()[0] or 1
        block = max(1, min(max(2048, math.ceil(n / 12)), HELD // max(1, width)))
    dealt = _pairs_of_blocks(rows, F.struct("_k", "_v"), n, block)
    part = dealt.groupBy("_i", "_j").applyInArrow(_summed, f"_k {kinds['_k']}, _c {kinds['_c']}, _c2 {kinds['_c']}, d double, n bigint")
    sums = part.groupBy("_k", "_c", "_c2").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own, other = F.col("_c") == F.col("_c2"), F.col("_c") != F.col("_c2")
    near = sums.groupBy("_k", "_c").agg(F.max(F.when(own, F.try_divide(F.col("d"), F.col("n") - 1))).alias("a"), F.min(F.when(other, F.col("d") / F.col("n"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return near.select(F.col("_k").alias(key), F.col("_c").alias(cluster), s.alias("silhouette"))


def choose_k(by_silhouette: int, by_tree: int, override: int | None = None) -> int:
    """The override if given, else what both say, else the silhouette's."""
    return override or (by_tree if by_silhouette == by_tree else by_silhouette)


def profiles(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean of every feature by cluster, and a last row (cluster null) for all rows."""
    return df.rollup(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in features])


def profile_scores(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """cluster, feature, z: how many deviations a cluster's mean is from the mean of all rows (null without deviation)."""
    whole = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"w_{c}") for c in features])
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in features]).withColumn("_j", F.lit(0)).join(F.broadcast(whole.withColumn("_j", F.lit(0))), "_j")
    z = means.select(cluster, *[ratio(F.col(c) - F.col(f"w_{c}.m"), F.nullif(F.col(f"w_{c}.s"), F.lit(0.0))).alias(c) for c in features])
    return z.unpivot([cluster], features, "feature", "z")


def strongest(scores: DataFrame, cluster: str = "cluster", k: int = 5) -> DataFrame:
    """The k features of each cluster with the largest |z| (ties by name)."""
    w = Window.partitionBy(cluster).orderBy(F.desc(F.abs("z")), "feature")
    return scores.where("z is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def standout(scores: DataFrame, least: float = 1.0, k: int = 50) -> DataFrame:
    """Features by largest |z| over clusters, those above `least`, k at most."""
    top = scores.groupBy("feature").agg(F.max(F.abs("z")).alias("most"))
    return top.where(F.col("most") > least).orderBy(F.desc("most"), "feature").limit(k)
