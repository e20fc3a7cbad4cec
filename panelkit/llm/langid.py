"""Language identification by Bayesian evidence fusion (operator 6).

Evidence of a page: its visible text (byte-trigram likelihoods, models counted on documents whose language is known),
the language its markup declares, and where it stands: a prior of its host, smoothed towards its domain, that towards
the address suffix, and that towards all pages. Declarations and priors are learnt from the pages themselves by grouped
aggregation of the text's posteriors, so a host or suffix that lies about its language counts for what it is. A page's
own share is taken out of its host's counts.

Sums by host, domain, suffix and declaration are combined before their shuffles; the join back to pages deals each host
over several tasks, so one with a third of all pages is no hot spot.

Defined results: null and empty html, or html without text, speaks through declaration and address alone; a null or
malformed url has host, domain and suffix ''; html of any length is read whole; languages that tie go to the first by
name; repeated rows are judged each for itself and all count; without labelled
documents there is no language and the result is empty; an empty table gives an empty result; other columns are kept
only if named in `keep`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_left_join, small_batches
from .shingles import mixed, pieces, text_bytes

BUCKETS = 1 << 15
#: Trigrams overlap and repeat, so at most so many count as independent evidence.
MOST_EVIDENCE = 60


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, at = text_bytes(texts)
    if len(body) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    b = body.astype(np.uint64)
    b += np.uint64(32) * ((b >= 65) & (b <= 90))
    same = owner[:-2] == owner[2:]
    three = (b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)))[same]
    return (mixed(three + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64), owner[:-2][same]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for begin, end in pieces(batch.column("text")):
            part = batch.slice(begin, end - begin)
            bucket, text = _trigrams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[(langs == lang)[text]], minlength=BUCKETS)
    for lang, n in sums.items():
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(n[full])], ["lang", "bucket", "n"])


def fit(documents: DataFrame, labelled_rows: int = 20_000) -> dict[str, np.ndarray]:
    """Language -> log probability of each bucket, from about labelled_rows documents chosen by hash of doc_id."""
    n = max(1, documents.count())
    few = small_batches(documents).where("lang is not null and text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, labelled_rows / n)))
    counts = few.select("lang", "text").mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    for r in counts.collect():  # languages x BUCKETS rows at most
        table.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return {lang: np.log((c + 0.1) / (c.sum() + 0.1 * BUCKETS)) for lang, c in sorted(table.items())}


def _likelihoods(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in pieces(batch.column("text")):
            part = batch.slice(begin, end - begin)
            bucket, text = _trigrams(part.column("text"))
            n = np.bincount(text, minlength=len(part))
            mean = np.stack([np.bincount(text, weights=row[bucket], minlength=len(part)) / np.maximum(n, 1) for row in table], axis=1)
            evidence = mean * np.minimum(n, MOST_EVIDENCE)[:, None]
            lists = pa.ListArray.from_arrays(np.arange(0, evidence.size + 1, len(table), dtype=np.int32), pa.array(evidence.reshape(-1)))
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], [*kept, "ll"])


def visible_text(html: Column) -> Column:
    """Markup taken out: comments, scripts, styles, then tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raised = [F.exp(x - top) for x in logs]
    total = reduce(lambda a, b: a + b, raised)
    return [x / total for x in raised]


def identify(pages: DataFrame, models: dict[str, np.ndarray], keep: tuple[str, ...] = ("page_id",), strength: float = 4.0) -> DataFrame:
    """`keep` columns, host, declared, text_lang (by text alone), lang and probability (by all evidence).

    strength: how many pages a prior's parent counts for.
    """
    langs = list(models)
    kept = small_batches(pages).select(*keep, "url", "html")
    if not langs:
        return kept.select(*keep, *[F.lit(None).cast("string").alias(c) for c in ("host", "declared", "text_lang", "lang")], F.lit(None).cast("double").alias("probability")).where("false")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    known = F.when(declared.isin(*langs), declared).otherwise(F.when(declared == "", F.lit("")).otherwise(F.lit("other")))
    rows = kept.select(*keep, host.alias("host"), known.alias("declared"), visible_text(F.col("html")).alias("text"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "text")
    table = np.stack([models[x] for x in langs])
    lik = rows.mapInArrow(lambda b: _likelihoods(b, table), f"{kinds}, ll array<double>")
    p = [f"p{i}" for i in range(len(langs))]
    by_text = lik.select("*", *[x.alias(c) for x, c in zip(_softmax([F.get("ll", i) for i in range(len(langs))]), p)])
    by_text = by_text.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    by_text = cut(by_text)

    sums = [F.sum(c).alias(c) for c in p]
    hosts = cut(by_text.groupBy("host", "domain", "suffix").agg(*sums))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()
    total = sum(x or 0 for x in whole) or 1.0
    everywhere = [((x or 0) + 1) / (total + len(p)) for x in whole]

    def smoothed(stats: DataFrame, parent: list[Column], name: str) -> DataFrame:
        n = reduce(lambda a, b: a + b, [F.col(c) for c in p])
        return stats.withColumns({f"{name}{i}": (F.col(c) + strength * parent[i]) / (n + strength) for i, c in enumerate(p)}).drop(*p)

    each = range(len(p))
    at_suffix = smoothed(suffixes, [F.lit(x) for x in everywhere], "s")
    # a suffix may have most domains, and a domain most hosts
    at_domain = smoothed(salted_left_join(domains, at_suffix, ["suffix"], F.col("domain")), [F.col(f"s{i}") for i in each], "d").select("domain", "suffix", *[f"d{i}" for i in each])
    at_host = salted_left_join(hosts, at_domain, ["domain", "suffix"], F.col("host")).select("host", *[F.col(c).alias(f"h{c}") for c in p], *[f"d{i}" for i in each])

    # P(declared | language): as many rows as there are languages and two
    said = by_text.groupBy("declared").agg(*sums).collect()
    spoken = [sum(r[c] for r in said) for c in p]
    channel = {r["declared"]: [math.log((r[c] + 0.5) / (spoken[i] + 0.5 * (len(langs) + 2))) for i, c in enumerate(p)] for r in said}
    log_declared = [F.coalesce(*[F.when(F.col("declared") == d, F.lit(v[i])) for d, v in channel.items()], F.lit(0.0)) for i in each]

    joined = salted_left_join(by_text, cut(at_host), ["host"], F.struct(*keep))
    own_less = [F.greatest(F.col(f"hp{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in each]
    n_less = reduce(lambda a, b: a + b, own_less)
    prior = [(own_less[i] + strength * F.col(f"d{i}")) / (n_less + strength) for i in each]
    posterior = _softmax([F.get("ll", i) + log_declared[i] + F.log(F.greatest(prior[i], F.lit(1e-12))) for i in each])
    out = joined.select(*keep, "host", "declared", *[F.col(c) for c in p], *[x.alias(f"q{i}") for i, x in enumerate(posterior)])

    def best(prefix: str) -> Column:
        top = F.greatest(*[F.col(f"{prefix}{i}") for i in each]) if len(langs) > 1 else F.col(f"{prefix}0")
        return F.coalesce(*[F.when(F.col(f"{prefix}{i}") == top, F.lit(x)) for i, x in enumerate(langs)])

    top = F.greatest(*[F.col(f"q{i}") for i in each]) if len(langs) > 1 else F.col("q0")
    return out.select(*keep, "host", "declared", best("p").alias("text_lang"), best("q").alias("lang"), top.alias("probability"))
