"""A corpus pipeline of the operators in panelkit.llm: quality, near duplicates, secrets, mixture, tokens.

run(spark, sf_dir) applies STAGES to the documents table. Each stage's rows are written as Parquet to the shared folder
and reread as the next one's documents. All but the last return the columns of documents.

In every stage: an empty table gives an empty result; a null text counts as an empty one (and stays null); a text of any
length is worked on whole; columns of any name beside those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import classifier, mixing, neardup, secrets
from panelkit.llm.common import cut
from panelkit.llm.queries import tokens_and_digests


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that a stage works on, and all others in one struct, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*others) if others else F.lit(None)).alias("_rest"))


def unpacked(rows: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in needed else F.col("_rest")[c].alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Null and empty texts score 0 and are judged by that; repeated rows are judged each for itself; ties at the border go
    to the smaller doc_id; without labels of both kinds all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = classifier.classify(packed(docs, "doc_id", "text"), labels).where("kept")
    return unpacked(kept, docs.columns, "doc_id", "text")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): the smallest doc_id.

    Texts without words are no duplicates of each other and stay; of repeated rows one stays; null ids come last.
    """
    kept = neardup.first_of_each(packed(docs, "doc_id", "text"), width=5, percent=80)
    return unpacked(kept, docs.columns, "doc_id", "text")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark and n_chars to match.

    Overlapping secrets give one mark; repeated rows are each redacted; null texts stay null.
    """
    model = secrets.fit(secrets.labelled_samples(docs.select("doc_id", "text")))
    needed = ("text", "n_chars")
    return unpacked(secrets.redact(secrets.scan(packed(docs, *needed), model)), docs.columns, *needed)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Texts without words are never taken; null sources are one source; repeated rows and ties count by (key, id, size).
    """
    needed = ("doc_id", "source", "text")
    plan = mixing.plan(mixing.keyed(docs.select(*needed)).drop("text"))
    mixed = mixing.mix(mixing.keyed(packed(docs, *needed)), plan).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size")))
    return unpacked(mixed.withColumn("_time", times), docs.columns, *needed)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of the bytes that decoding them gives.

    Null and empty texts have no ids; repeated rows are encoded each for itself.
    """
    return tokens_and_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_to_weights),
    ("byte-level BPE", byte_bpe),
]

#: SQL cannot express the first two stages' models; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
