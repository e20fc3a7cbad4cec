"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 5).

Every document draws one exponential key, scaled by its quality: key = -ln(u) / quality, smallest first. A source that
is to give t words from s takes every document floor(t / s) times (complete epochs come first) and fills the rest in
key order until the prefix sum of words reaches it. u comes from a hash of the seed and doc_id, so reruns agree.

Nothing sorts a whole source: words are summed by (source, key bucket), the running sum of those few rows shows the one
bucket in which the budget ends, and only that bucket's documents are ordered. So a source that holds a third of all
rows costs no more in one task than any other.

Defined results: a null text counts 0 words and is never taken; null sources form one source, ranked last; repeated
rows are mixed each for itself (equal keys are ordered by doc_id, then by size; rows equal in all three count alike); a
text of any length is one document, taken whole or not; an empty table gives an empty result; columns of any name are
kept, but that those named like the added ones (ADDED) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, salted_left_join, whole_text

ADDED = ("size", "quality_weight", "key", "bucket", "source_size", "target", "taken")


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: falls with the number of symbols a word."""
    return F.lit(1.0) / (1 + F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / F.greatest(size, F.lit(1)))


def keyed(docs: DataFrame, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """docs with size (words), quality_weight, key, and bucket: a monotone quantisation of key into `buckets` parts."""
    sized = docs.drop(*ADDED).withColumn("size", F.regexp_count(whole_text(), F.lit(WORD)).cast("long"))
    sized = sized.withColumn("quality_weight", quality_weight(whole_text(), F.col("size")))
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = sized.withColumn("key", -F.log(u) / F.col("quality_weight"))
    return drawn.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: share * all words dealt by weight, none above cap * source_size.

    Weights repeat over the sources by code point, null last. What a capped source leaves goes to the others by weight:
    with sources in order of cap / weight, the level at which the rest fits follows from two running sums. One row a
    source is all that these unpartitioned windows see.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sources.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank, F.lit(len(weights)))))
    w = w.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = w.withColumn("level", level).withColumn("water", F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(everything))
    return levelled.select("source", "source_size", F.least("most", F.col("water") * F.col("w")).alias("target"))


def plan(rows: DataFrame, **how: object) -> DataFrame:
    """One row a source of keyed rows: source, source_size, target, epochs, rest, edge (bucket in which rest ends) and edge_before (words below it)."""
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    target = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **how)
    target = target.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    target = target.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
    edge = run.join(target.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("rest"))
    edge = edge.groupBy("s").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("edge_before"))
    return target.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(rows: DataFrame, plan_rows: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """keyed rows with source_size, target and taken (words the mix takes of the row; a multiple of its size).

    plan_rows is broadcast only up to `broadcast_rows` sources; beyond that a salted join deals hot sources out.
    """
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    p = cut(plan_rows.select(name, "source_size", "target", "epochs", "rest", "edge", "edge_before"))
    packed = rows.select(F.struct("*").alias("row"), name, "bucket", "size", "key", "doc_id")
    small = p.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = packed.join(F.broadcast(p), "name", "left") if small else salted_left_join(packed, p, ["name"], F.struct("key", "doc_id"))
    upto = F.sum("size").over(Window.partitionBy("name").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = joined.where(F.col("bucket") == F.col("edge"))
    at_edge = at_edge.withColumn("more", (F.col("edge_before") + upto - F.col("size") / 2 <= F.col("rest")).cast("long"))
    others = joined.where(F.coalesce(F.col("bucket") != F.col("edge"), F.lit(True)))
    others = others.withColumn("more", (F.col("bucket") < F.coalesce(F.col("edge"), F.lit(1 << 30))).cast("long"))
    taken = F.col("size") * (F.col("epochs") + F.col("more"))
    return at_edge.unionByName(others).select("row.*", "source_size", "target", taken.alias("taken"))
