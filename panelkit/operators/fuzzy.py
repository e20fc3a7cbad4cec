"""The k most similar candidates of every name, exactly, through inverted lists of letters and letter pairs.

Similarity is 100 * (1 - d / m): d the Levenshtein distance of the lower-cased strings, m the longer one's length.

1. Each string is a bag of pairs of letters and a bag of letters; the n-th occurrence of a token is a token of its own.
   Tokens are ordered by how many candidates have them.
2. A name's rarest pairs, up to `budget` postings, give candidates; the k-th best of these is the name's bar. It only
   helps: a bar of 0 is a bar too.
3. For every length that candidates have, the bar says how many edits are left. With d edits two strings have at least
   m - 1 - 2d pairs and m - d letters in common, so one of the name's |pairs| - (m - 1 - 2d) + 1 rarest pairs, or of its
   |letters| - (m - d) + 1 rarest letters where pairs promise nothing, is in the candidate. Lists are looked up by token
   and length, so no candidate that could reach the bar is missed, and lengths out of reach are not looked up.
4. Candidates without a letter of the name score 0: the first ones by name fill what is missing to k.

Lists of more than `part` candidates are dealt into parts by the counted length of the list, so a frequent letter is
no single task's work.

Defined results: null names and candidates are ignored, repeated ones count once; ties go by the candidate; an empty name
is like an empty candidate and shares nothing with others; with fewer than k candidates all are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: how little of the longer string has to be edited, whatever the case."""
    a, b = F.lower(a), F.lower(b)
    return 100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def _strings(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias(name)).distinct().withColumn("low", F.lower(name)).withColumn("m", F.length("low"))


def _tokens(strings: DataFrame, name: str) -> DataFrame:
    """name, m, kind (2: pairs, 1: letters), token, nth."""
    runs = strings.withColumn("kind", F.explode(F.array(F.lit(1), F.lit(2)))).where("m >= kind")
    token = F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("kind") + 1), lambda i: F.substring("low", i, F.col("kind"))))
    counted = runs.select(name, "m", "kind", token.alias("token")).groupBy(name, "m", "kind", "token").count()
    return counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("count")


def _met(probes: DataFrame, postings: DataFrame, keys: list[str]) -> DataFrame:
    """(name, candidate) of probes and the lists they look up; probes carry `parts` and go to each of them."""
    asked = probes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return asked.join(postings, [*keys, "_part"]).select("name", "candidate").distinct()


def top(a: DataFrame, b: DataFrame, k: int = 5, budget: int = 200, part: int = 2000) -> DataFrame:
    """name, rank, candidate, score: the k best candidates (column candidate of b) of each name (column name of a)."""
    key = ["kind", "token", "nth"]
    names, candidates = cut(_strings(a, "name")), cut(_strings(b, "candidate"))
    lists = _tokens(candidates, "candidate")
    counts = cut(lists.groupBy(*key).agg(F.count("*").alias("n"), F.ceil(F.count("*") / part).cast("int").alias("parts")))
    postings = cut(lists.join(counts.select(*key, "parts"), key).withColumn("_part", F.pmod(F.xxhash64("candidate"), F.col("parts")).cast("int")).drop("parts"))
    order = Window.partitionBy("name", "kind").orderBy("n", "token", "nth")
    known = _tokens(names, "name").join(counts, key, "left").na.fill({"n": 0, "parts": 1})
    known = known.withColumns({"pos": F.row_number().over(order), "upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    known = cut(known)

    # the bar: what the rarest pairs find, and equal strings
    few = known.where((F.col("kind") == 2) & (F.col("n") > 0) & ((F.col("upto") <= budget) | (F.col("upto") == F.col("n"))))
    same = names.join(candidates.select("candidate", "low"), "low").select("name", "candidate")
    met = _met(few, postings, key).union(same).distinct()
    first = cut(met.withColumn("score", similarity(F.col("name"), F.col("candidate"))))
    ranked = Window.partitionBy("name").orderBy(F.desc("score"), "candidate")
    bars = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("name", F.col("score").alias("bar"))

    # by length: the edits that the bar leaves, and the tokens of which one must be shared
    lengths = [r["m"] for r in candidates.select("m").distinct().collect()]  # no more than the longest candidate has letters
    every = F.explode(F.array(*[F.lit(x) for x in sorted(lengths)])) if lengths else F.explode(F.array().cast("array<int>"))
    asked = names.select("name", F.col("m").alias("own")).join(bars, "name", "left").na.fill(0.0, ["bar"]).withColumn("m", every)
    longer = F.greatest("own", "m")
    asked = asked.withColumn("edits", F.floor((1 - F.col("bar") / 100) * longer + 1e-9).cast("int")).where(F.abs(F.col("own") - F.col("m")) <= F.col("edits"))
    pairs, letters = longer - 1 - 2 * F.col("edits"), F.greatest(longer - F.col("edits"), F.lit(1))
    asked = asked.withColumns({"kind": F.when(pairs >= 1, 2).otherwise(1), "take": F.when(pairs >= 1, F.col("own") - 1 - pairs + 1).otherwise(F.col("own") - letters + 1)})
    probes = asked.select("name", "m", "kind", "take").join(known.drop("m"), ["name", "kind"]).where((F.col("pos") <= F.col("take")) & (F.col("n") > 0))
    found = _met(probes, postings, [*key, "m"]).join(first.select("name", "candidate"), ["name", "candidate"], "left_anti")
    scored = found.withColumn("score", similarity(F.col("name"), F.col("candidate"))).where("score > 0")
    best = cut(first.where("score > 0").unionByName(scored).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))

    # no letter in common: score 0, in the order of the candidates
    fill = [r["candidate"] for r in candidates.orderBy("candidate").limit(2 * k).select("candidate").collect()]  # 2 k names
    short = names.select("name").join(best.groupBy("name").count(), "name", "left").na.fill(0, ["count"]).where(F.col("count") < k)
    if fill:
        blank = short.select("name", F.explode(F.array(*[F.lit(c) for c in fill])).alias("candidate")).join(best.select("name", "candidate"), ["name", "candidate"], "left_anti")
        best = best.drop("rank").unionByName(blank.withColumn("score", F.lit(0.0))).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("name", "rank", "candidate", "score")
