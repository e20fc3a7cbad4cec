"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers (operator 2).

Two first-order Markov models over ASCII, one of random strings and one of ordinary words, are counted by grouped
aggregation over labelled samples. A candidate string is a secret if the log-likelihood ratio of the two is high.
The table of ratios (128 x 128, whatever the corpus) is a literal array in the plan, so scoring is one array lookup a
character inside the scan. No shuffle, no Python.

Work is linear in a text's length and in its spans: characters are looked up in an array made once, what lies between
spans is cut from fixed-width code points, and running sums are taken by chunks.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; a text of any length, of
one unbroken run too, is scanned whole; repeated rows are scanned each for itself; an empty table gives an empty result
and a model of random strings alone; spans that start together stand in the order of KINDS; scan() adds the column
`spans` (replacing one of that name) and keeps all other columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: The base patterns, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "markov")
#: What the models judge: runs of these characters, of 20 or more.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
SPANS = "array<struct<start:int,rank:int,end:int>>"
CODES = 128


#: Items of a run inside which what stands before each is summed up anew.
CHUNK = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array of non-negative ints, all items before it combined (0 for the first).

    Sums of chunks, then sums inside a chunk: an accumulator that is a growing array would be copied at every step.
    """
    total = lambda part: F.aggregate(part, F.lit(0), combine)
    parts = _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK)))

    def inside(part: Column, base: Column) -> Column:
        return F.transform(part, lambda _, k: combine(base, F.when(k == 0, F.lit(0)).otherwise(total(F.slice(part, 1, k)))))

    def placed(ps: Column, sums: Column) -> Column:
        return F.flatten(F.transform(ps, lambda part, c: _let(F.when(c == 0, F.lit(0)).otherwise(total(F.slice(sums, 1, c))), lambda base: inside(part, base))))

    return _let(parts, lambda ps: _let(F.transform(ps, total), lambda sums: placed(ps, sums)))


def _placed(text: Column, pattern: str, kept: Column, rank: int) -> Column:
    """Spans of the pattern's matches. kept: an array of booleans, one for each match.

    Splitting at the pattern gives what lies between its matches, so lengths before a match add up to its start.
    """
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.transform(matches, lambda m: F.length(m)), between, lambda m, b: F.struct(m.alias("len"), F.length(b).alias("gap")))
    pairs = F.zip_with(F.filter(pairs, lambda p: p["len"].isNotNull()), kept, lambda p, k: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), k.alias("kept")))

    def spans(ps: Column) -> Column:
        starts = _before(F.transform(ps, lambda p: p["gap"] + p["len"]), lambda x, y: x + y)
        every = F.zip_with(ps, starts, lambda p, at: F.struct(p["kept"].alias("kept"), (at + p["gap"]).alias("start"), (at + p["gap"] + p["len"]).alias("end")))
        return F.transform(F.filter(every, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))

    return F.when(F.exists(kept, lambda k: k), _let(pairs, spans)).otherwise(F.array().cast(SPANS))


def _rebuilt(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """The text with every span, or what of it no span before covers, replaced by `instead` of its length and of whether
    it begins outside earlier spans.

    Spans are in order of their starts. Pieces are cut from UTF-32, in which a place is a byte offset.
    """

    def piece(wide: Column, at: Column, size: Column) -> Column:
        # behind a space, since a leading U+FEFF would count as a byte order mark
        return F.substring(F.decode(F.concat(F.unhex(F.lit("00000020")), F.substring(wide, at * 4 + 1, size * 4)), "UTF-32"), F.lit(2), size)

    def changed(wide: Column, x: Column, at: Column) -> Column:
        begin, end = F.greatest(at, x["start"]), F.greatest(at, x["end"])
        return F.concat(piece(wide, at, begin - at), F.when(end > begin, instead(end - begin, x["start"] >= at)).otherwise(""))

    def whole(wide: Column) -> Column:
        ends = F.transform(spans, lambda x: x["end"])
        pieces = F.zip_with(spans, _before(ends, lambda x, y: F.greatest(x, y)), lambda x, at: changed(wide, x, at))
        last = F.array_max(ends)
        return F.concat(F.array_join(pieces, ""), piece(wide, last, (F.length(wide) / 4).cast("int") - last))

    return F.when(F.size(spans) > 0, _let(F.encode(text, "UTF-32"), whole)).otherwise(text)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind. A run of 24+ hex digits (20+ of an access key) is found directly: shorter runs are the failing matches."""
    everything = F.concat(
        _placed(text, ASSIGN, F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6), 0),
        _placed(text, ACCESS, F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda v: F.lit(True)), 1),
        _placed(text, HEX, F.transform(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), lambda v: F.lit(True)), 2),
    )
    return F.sort_array(everything)


def labelled_samples(docs: DataFrame, sample_docs: int = 2000, random_strings: int = 3000) -> DataFrame:
    """(random boolean, s): labelled strings. Random ones are digests written as hex, base64 and base-32-like text, and the
    values that base patterns find in the sampled documents; ordinary ones are the sampled documents' other words.

    sample_docs bounds the sample of documents (chosen by hash of doc_id); it serves the fitting alone.
    """
    spark = docs.sparkSession
    n = max(1, docs.count())
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max(1, round(1_000_000 * min(1.0, sample_docs / n)))).select(whole_text().alias("t"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(random_strings).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 20)))).alias("s")
    )
    values = few.select(F.explode(F.concat(F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 16), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)))).alias("s"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = few.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("s"))
    return made.union(values).select(F.lit(True).alias("random"), "s").union(words.select(F.lit(False).alias("random"), "s"))


def fit(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each pair of ASCII codes: CODES * CODES numbers, whatever the input."""
    pairs = samples.where(F.length("s") >= 2).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
    codes = pairs.select("random", F.ascii("p").alias("a"), F.ascii(F.substring("p", 2, 1)).alias("b")).where((F.col("a") < CODES) & (F.col("b") < CODES))
    count = {(r["random"], r["a"], r["b"]): r["n"] for r in codes.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    alphabet = 68
    total: dict[tuple[bool, int], int] = {}
    for (kind, a, _), n in count.items():
        total[kind, a] = total.get((kind, a), 0) + n

    def log_p(kind: bool, a: int, b: int) -> float:
        return math.log((count.get((kind, a, b), 0) + smooth) / (total.get((kind, a), 0) + smooth * alphabet))

    return [round(log_p(True, a, b) - log_p(False, a, b), 4) for a in range(CODES) for b in range(CODES)]


def log_ratio(s: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over the ASCII string's pairs of neighbours."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        return F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] >= 0, F.coalesce(F.get(table, a["last"] * CODES + c), F.lit(0.0))).otherwise(0.0)).alias("sum"))

    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, zero, step, lambda a: a["sum"])


def scan(docs: DataFrame, model: list[float], least: float = 8.0, least_mean: float = 0.3) -> DataFrame:
    """docs with `spans`: array of (start, kind, end) by start, then kind in the order of KINDS.

    A candidate is a run of CANDIDATE outside base spans (a base span inside a run leaves the parts beside it). It counts
    if its log-likelihood ratio is `least` or more in all and `least_mean` or more a pair.
    """
    judged = lambda v: log_ratio(v, model) >= F.greatest(F.lit(least), F.lit(least_mean) * (F.length(v) - 1))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "spans"]).alias("row"), whole_text().alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t")))
    rows = rows.withColumn("left", _rebuilt(F.col("t"), F.col("base"), lambda size, _: F.repeat(F.lit(" "), size)))
    runs = F.regexp_extract_all("left", F.lit(CANDIDATE), F.lit(0))
    rows = rows.withColumn("more", _placed(F.col("left"), CANDIDATE, F.transform(runs, judged), 3))
    named = F.transform(F.sort_array(F.concat("base", "more")), lambda x: F.struct(x["start"].alias("start"), F.get(F.array(*map(F.lit, KINDS)), x["rank"]).alias("kind"), x["end"].alias("end")))
    return rows.select("row.*", named.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """scanned with every span in text replaced by a mark (overlapping spans by one), n_chars to match, and without spans."""
    clean = _rebuilt(F.col("text"), F.col("spans"), lambda size, apart: F.when(apart, F.lit(mark)).otherwise(""))
    out = scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("spans") if "n_chars" in out.columns else out.drop("spans")
