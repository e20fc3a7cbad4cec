"""Quality rules: a threshold table compiled into one Spark projection (operator 4).

Defined results: null and empty texts have no words and fail as texts of too few; a text of any length is measured whole;
metrics equal to a threshold pass; repeated rows are judged each for itself; an empty table gives an empty result; other
columns, whatever their names, are ignored and not in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole_text


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= metric <= high (either may be None); metrics are names of METRICS.

    only_from: the rule speaks only on texts of so many words, because ratios of short texts are noise.
    """

    metric: str
    low: float | None = None
    high: float | None = None
    only_from: int = 0


#: metric -> SQL over the measured columns. The same text serves Spark and the oracle.
METRICS: dict[str, str] = {
    "words": "n_words",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    "repeated_word_ratio": "n_repeat_words / greatest(n_words, 1)",
    "repeated_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
}

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS: tuple[str, ...] = (
    "a", "al", "an", "and", "au", "auf", "be", "by", "con", "dans", "das", "de", "del", "den", "der", "des", "die", "du", "ein", "el", "en", "est", "et", "for", "from", "für", "he", "il", "im", "in", "is", "ist", "la", "las", "le",
    "les", "los", "mit", "ne", "nicht", "of", "on", "or", "par", "para", "pas", "por", "pour", "que", "qui", "se", "sich", "sie", "son", "su", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu",
)

DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("words", low=10),
    Rule("repeated_word_ratio", high=0.2),
    Rule("mean_word_length", low=2, high=14),
    Rule("symbols_per_word", high=0.5),
    Rule("stop_word_ratio", low=0.02, only_from=100),
    Rule("repeated_line_ratio", high=0.5),
)


def compile_rules(rules: tuple[Rule, ...]) -> str:
    """One boolean SQL expression: true where every rule of the table holds."""
    parts = []
    for r in rules:
        bounds = [f"({METRICS[r.metric]}) >= {r.low}"] * (r.low is not None) + [f"({METRICS[r.metric]}) <= {r.high}"] * (r.high is not None)
        held = " AND ".join(bounds) or "true"
        parts.append(f"(n_words < {r.only_from} OR ({held}))" if r.only_from else f"({held})")
    return " AND ".join(parts) or "true"


def _windows(words: Column, width: int) -> Column:
    """A 64-bit hash of each window of `width` words, chained word by word, so that word borders count."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    return F.slice(hashed, 1, F.greatest(F.size(words) - F.lit(width - 1), F.lit(0)))


def measure(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and the measured columns of each row: n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words.

    Null and empty texts measure 0 everywhere. Rows are judged alone: repeated rows give repeated results, and other
    columns of docs are ignored. One projection, no shuffle.

    n_repeat_words counts the words that lie in a window of `width` words which the text holds twice or more. Only
    where some window repeats are the windows sorted with their places; the union of equal intervals with sorted
    starts s is then width + sum(min(width, s[i+1] - s[i])).
    """
    text = docs.select("doc_id", whole_text().alias("_t"))
    cols = text.select(
        "doc_id",
        F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_l"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    grams = cols.select("*", _windows(F.col("_w"), width).alias("_g"))
    starts = grams.select(
        "*",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("_s"),
    )
    # a window repeats if a neighbour in sorted order is the same
    again = starts.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform("_s", lambda x, k: F.struct(x["i"].alias("i"), ((F.get("_s", k - 1)["g"] == x["g"]) | (F.get("_s", k + 1)["g"] == x["g"])).alias("twice"))),
                    lambda x: F.coalesce(x["twice"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ).alias("_d"),
    )
    covered = F.when(
        F.size("_d") > 0,
        F.aggregate(F.transform("_d", lambda x, k: F.least(F.lit(width), F.coalesce(F.get("_d", k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x),
    ).otherwise(0)
    return again.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """measure() with `kept`: the compiled threshold table."""
    return measure(docs).withColumn("kept", F.expr(compile_rules(rules)))
