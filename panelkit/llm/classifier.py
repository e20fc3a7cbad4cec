"""Quality classifier by importance resampling (operator 7).

Two bag-of-n-gram models over hashed buckets, one of the target text (labelled good) and one of all raw text, give each
document an importance score log p(target) - log p(raw), here per n-gram so that long texts are not favoured. With T the
score that separates the labelled sample best, a document's log weight is (score - T) / temperature. Gumbel noise is added
to it, and the k documents with the largest sums are sampled without replacement (Gumbel top-k). k is the weight mass: the
sum of 1 - exp(-weight), the number of documents that a draw at this weight is expected to hold. The temperature is the
largest at which the draw still keeps `keep` of the labelled good rows, so the noise decides near T as far as these allow:
documents above T are hardly ever lost, and one below has a chance that falls with its distance.

The n-grams are byte trigrams (of every script and layout), word bigrams, and for each word the distance to its last
occurrence among the words before it, so that repetition has its own buckets.

The corpus is read twice, by numpy over Arrow batches: once to count (a bounded table of counts per task, summed by
Spark), once to weigh. The top k is found without a sort: keys are counted in fixed-width bins, the bin in which k falls
is cut into bins again, and only what is left of it at last is ordered. labelled_rows bounds the labelled sample, which is
broadcast; raw counts cover all rows.

Defined results: null and empty texts have no n-grams and score 0; a text of any length is weighed whole; repeated rows
are judged each for itself (equal keys are ordered by doc_id, then text hash); without labels of both kinds every document
is kept and its key is its score; an empty table gives an empty result; all columns of docs are kept, whatever their
names, but that added ones (ADDED) replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, small_batches
from .shingles import mixed, pieces, text_bytes, word_hashes, words

BUCKETS = 1 << 15
REACH = 8
#: Bytes of text whose n-grams a worker holds at once (some 90 bytes a byte of text), and rows of an Arrow batch.
AT_ONCE, ROWS_AT_ONCE = 250_000, 500
ADDED = ("score", "key", "kept")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram: byte trigrams, word bigrams, and repetition distances (buckets 0..REACH)."""
    body, at = text_bytes(texts)
    start, end, first = words(body, at)
    h = word_hashes(body, start, end, lower=False)
    span = np.uint64(BUCKETS - REACH - 1)
    inside = np.repeat(np.arange(len(at) - 1), np.diff(at))
    b = body.astype(np.uint64)
    three = b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)) if len(b) > 2 else b[:0]
    same = inside[: len(three)] == inside[2:] if len(b) > 2 else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    two = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else h[:0]
    pair = owner[:-1] == owner[1:] if len(h) > 1 else np.zeros(0, bool)
    back = np.zeros(len(h), dtype=np.int64)
    for d in range(REACH, 0, -1):
        hit = (h[d:] == h[:-d]) & (owner[d:] == owner[:-d])
        back[d:][hit] = d
    bucket = np.concatenate([mixed(three[same] + np.uint64(1 << 40)) % span + np.uint64(REACH + 1), mixed(two[pair]) % span + np.uint64(REACH + 1), back.astype(np.uint64)])
    text = np.concatenate([inside[: len(three)][same], owner[:-1][pair] if len(h) > 1 else owner[:0], owner])
    return bucket.astype(np.int64), text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for begin, end in pieces(batch.column("text"), AT_ONCE):
            part = batch.slice(begin, end - begin)
            bucket, text = grams(part.column("text"))
            good = np.asarray(part.column("quality").fill_null(-1)) == 1
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[text]], minlength=BUCKETS)
    full = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(target[full])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw for each bucket. labels: doc_id, quality, bounded; docs: all raw text."""
    marked = small_batches(docs, ROWS_AT_ONCE).select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left").select("text", "quality")
    counts = marked.mapInArrow(_counted, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most, whatever the corpus
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = 1.0
    return np.log((target + smooth) / (target.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS))


def _weighed(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in pieces(batch.column("text"), AT_ONCE):
            part = batch.slice(begin, end - begin)
            bucket, text = grams(part.column("text"))
            n = np.bincount(text, minlength=len(part))
            score = np.bincount(text, weights=ratio[bucket], minlength=len(part)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs with score: the mean log ratio of the text's n-grams."""
    docs = small_batches(docs, ROWS_AT_ONCE).drop("score")
    return docs.mapInArrow(lambda b: _weighed(b, ratio), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def label_sample(labels: DataFrame, labelled_rows: int = 20_000) -> DataFrame:
    """doc_id and quality of labelled_rows labels at most, chosen by hash of doc_id."""
    few = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    return cut(few.groupBy("doc_id").agg(F.max("quality").alias("quality")))


def threshold(scored_labels: list[tuple[float, int]], keep: float = 0.999) -> float:
    """The score that separates labelled rows best (half way to the next bad row below) among those that keep at least `keep` of the good ones."""
    good = np.sort([s for s, q in scored_labels if q == 1])
    bad = np.sort([s for s, q in scored_labels if q == 0])
    if not len(good) or not len(bad):
        return float("-inf")
    lowest = good[: int(len(good) * (1 - keep)) + 1]
    best = max(lowest, key=lambda x: np.searchsorted(bad, x) / len(bad) - np.searchsorted(good, x) / len(good))
    below = np.searchsorted(bad, best)
    return float((best + bad[below - 1]) / 2) if below else float("-inf")


def temperature(above: np.ndarray, keep: float) -> float:
    """The largest temperature at which documents whose scores lie so far above T stay with a chance of `keep` on average."""
    def kept(t: float) -> float:
        return float(np.mean(-np.expm1(-np.exp(np.minimum(above / t, 50)))))

    above = above[above > 0]
    if not len(above):
        return 1e-9
    low, high = 1e-9, float(above.max())
    for _ in range(60):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if kept(middle) >= keep else (low, middle)
    return low


def gumbel(seed: int) -> Column:
    """Gumbel noise from a hash of doc_id, so that reruns agree."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def top_k(keyed: DataFrame, k: int, bins: int = 4096, few: int = 1_000) -> DataFrame:
    """keyed (with key and text hash _h) with kept: whether a row is among the k largest keys, ties by doc_id, then _h.

    few: rows of the last bin that are ordered in one task, unless all their keys are equal.
    """
    above = float("inf")  # keys from here on are kept, those below low are not
    low, high, left = None, None, k
    while True:
        inside = keyed if low is None else keyed.where((F.col("key") >= low) & (F.col("key") < above))
        low, high, n = inside.agg(F.min("key"), F.max("key"), F.count("*")).first()
        if not n or left <= 0 or left >= n:
            least = float("inf") if not n or left <= 0 else low
            return keyed.withColumn("kept", F.col("key") >= (least if n and left >= n else above))
        if n <= few or high <= low:
            break
        width = (high - low) / bins
        binned = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"))
        for r in sorted(binned.collect(), key=lambda r: -r["bin"]):  # bins rows at most
            if r["n"] >= left:
                low = r["low"]
                break
            left, above = left - r["n"], r["low"]
    edge = (F.col("key") >= low) & (F.col("key") < above)
    ranked = keyed.where(edge).withColumn("kept", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("key"), "doc_id", "_h")) <= left)
    return ranked.unionByName(keyed.where(~edge).withColumn("kept", F.col("key") >= above))


def classify(docs: DataFrame, labels: DataFrame, seed: int = 1, labelled_rows: int = 20_000, keep: float = 0.999) -> DataFrame:
    """docs with score, key and kept, written once to the shared folder."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", *ADDED)]
    rows = docs.select("doc_id", "text", *([F.struct(*others).alias("_rest")] if others else []))
    sample = label_sample(labels, labelled_rows)
    weighed = cut(weigh(rows, fit(rows, sample)).withColumn("_h", F.xxhash64("text")).withColumn("_noise", gumbel(seed)))
    # one row a label: labelled_rows at most
    known = weighed.select("doc_id", "score").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("score").alias("score")).collect()
    least = threshold([(r["score"], r["quality"]) for r in known], keep)
    if least == float("-inf"):
        chosen = weighed.withColumn("key", F.col("score")).withColumn("kept", F.lit(True))
    else:
        scale = temperature(np.array([r["score"] - least for r in known if r["quality"] == 1]), keep)
        log_weight = (F.col("score") - least) / scale
        drawn = -F.expm1(-F.exp(F.least(log_weight, F.lit(50.0))))
        mass = weighed.agg(F.sum(F.round(drawn, 9).cast("decimal(18,9)"))).first()[0] or 0  # decimals: the order of summing does not show
        chosen = top_k(weighed.withColumn("key", log_weight + F.col("_noise")), round(mass))
    back = [F.col("_rest")[c].alias(c) if c in others else F.col(c) for c in docs.columns if c not in ADDED]
    return chosen.select(*back, *ADDED)
