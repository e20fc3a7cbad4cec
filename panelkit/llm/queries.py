"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, classifier, langid, licenses, mixing, neardup, prefixtrie, quality, secrets, setjoin, tokenfile, whitening
from .common import cut, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def _license_sql() -> str:
    index = ", ".join(f"({t}, '{label}', '{phrase}', {at}, '{word}')" for t, label, phrase, at, word in licenses.index())
    phrases = ", ".join(f"('{p}', {p.split()}, {repr(licenses.PHRASES[p]) if p in licenses.PHRASES else 'NULL'})" for p in licenses.phrases())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
idx(template, label, phrase, tpos, word) AS (VALUES {index}),
ph(phrase, p, base) AS (VALUES {phrases}),
x AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT rid, w[i] AS word, i - 1 AS pos FROM x WHERE w[i] IN (SELECT word FROM idx)),
df AS (SELECT word, count(DISTINCT rid) AS df FROM h GROUP BY word),
wt AS (SELECT idx.*, ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM idx LEFT JOIN df USING (word) WHERE coalesce(df, 0) <= greatest(0.2::DOUBLE * (SELECT count(*) FROM d), 50)),
whole AS (SELECT template, sum(idf) AS whole FROM wt GROUP BY template),
pl AS (SELECT rid, phrase, base, i - 1 AS start FROM x JOIN ph ON w[i] = p[1] WHERE w[i : i + len(p) - 1] = p),
lk AS (SELECT h.rid, wt.template, wt.label, any_value(whole) AS whole, sum(wt.idf) AS held FROM h JOIN wt USING (word) JOIN whole USING (template)
       WHERE EXISTS (SELECT 1 FROM pl WHERE pl.rid = h.rid AND pl.phrase = wt.phrase) GROUP BY h.rid, wt.template, wt.label, h.pos - wt.tpos),
f AS (SELECT rid, list(DISTINCT label) AS found, max(score) AS score FROM (SELECT rid, label, least(1, held / greatest(whole, 1e-9)) AS score FROM lk) WHERE score >= 0.5 GROUP BY rid),
b AS (SELECT rid, count(*) AS n, min(start) AS lo, max(start) AS hi, list(DISTINCT base) AS labels FROM pl WHERE base IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels, round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)"""


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.fit(secrets.labelled_samples(docs))
    found = secrets.scan(docs, model)
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def tokens_and_digests(docs: DataFrame, rank_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids go through the decoder."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path(rank_file), public_tokenizers.PATTERN, decoded=True)
    ids_sha256 = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_and_digests(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.judge(_table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND ({quality.compile_rules(quality.DEFAULT_RULES)}) AS kept
FROM f"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(mixing.keyed(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return mixing.mix(rows, mixing.plan(rows)).select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
                  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT + 0.5) / pow(2, 52) AS u FROM documents),
k AS (SELECT *, -ln(u) / (1.0::DOUBLE / (1 + n_symbols / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS most, 2.0 * source_size / w AS ratio FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM c
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, w * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
j AS (SELECT k.*, source_size, target, epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, r) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (upto - size / 2 <= target - epochs * source_size)::INT))::BIGINT AS taken FROM j"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "pages"), langid.fit(_table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "score", "key", "kept")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tokenfile.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(spark.read.schema(tokenfile.BLOCK_SCHEMA).parquet(path))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_tree(_table(spark, sf_dir, "conversations"))


PREFIX_TRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h FROM t GROUP BY conv_id),
m AS (SELECT n.conv_id, n.h, least(n.h, coalesce(b.n, 0)) AS m FROM n LEFT JOIN n b ON b.conv_id = n.conv_id - n.conv_id % 20),
r AS (SELECT conv_id, pos - h + m AS d, role, txt FROM t JOIN m USING (conv_id) WHERE pos > h
      UNION ALL SELECT m.conv_id, t.pos, t.role, t.txt FROM m JOIN t ON t.conv_id = m.conv_id - m.conv_id % 20 AND t.pos <= m.h),
p AS (SELECT conv_id, d, len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS words,
             md5(string_agg(length(role) || ':' || role || length(txt) || ':' || txt, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM n),
q AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS par, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
g AS (SELECT k, d, any_value(par) AS par, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY k, d),
c AS (SELECT par, count(*) AS n FROM g WHERE par IS NOT NULL GROUP BY par),
o AS (SELECT g.*, coalesce(c.n, 0) AS n_children FROM g LEFT JOIN c ON c.par = g.k),
s AS (SELECT q.k, sum((o.n_convs - 1) * o.words) AS saved, count(*) FILTER (WHERE o.n_children = 0) AS leaves FROM o JOIN q ON q.conv_id = o.conv_id AND q.d <= o.d GROUP BY q.k)
SELECT o.conv_id, o.d::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (k) LEFT JOIN o u ON u.k = o.par"""


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(_table(spark, sf_dir, "documents"), width=5, percent=80)


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_secret_scans": op2_secret_scans,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op1_license_scans": _license_sql(),
    "op4_quality_rules": _quality_sql(),
    "op5_mixing": MIXING_SQL,
    "op8_minhash_near_dedup": NEAR_DEDUP_SQL,
    "op12_prefix_trie": PREFIX_TRIE_SQL,
    "op13_jaccard_join": JACCARD_SQL,
}
