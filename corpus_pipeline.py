"""A corpus pipeline: language ID, near-dedup, decontamination, secret scan, BPE.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns a DataFrame, which ``run`` writes to the shared folder as Parquet and reads again. All
stages but the last return the columns of documents.

Defined cases, in every stage: a document with a null or empty text has no language and goes in the
first stage; a null in another column is passed on as it is; an empty table gives no rows with the
same columns; very long texts are worked on whole; of repeated rows and of ties in the id one row
stays (near_dedup); extra columns of any name and type pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm import bpe, decontam, langid, nearcopies, secrets
from prosegrid.llm.base import table
from prosegrid.scratch import remove, scope, scratch_path

#: A document is rejected if it has no letters or no language is more likely than all others together.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of an identified language; learns from the rows that are not held out."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select(F.struct("*").alias("__own"), F.col("text")), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("__own.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word Jaccard of 0.8 or more).

    The Gray-ordered SimHash index finds the candidates among all texts, an exact check follows.
    """
    return nearcopies.keep_one(docs, words_each=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which fewer than one word in 20 lies in a benchmark passage."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; documents without one stay as they are."""
    own = secrets.redact(docs)
    if "n_chars" not in own.columns:
        return own
    return own.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and digests of the ids and of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", tokens),
]

#: Models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is removed when the next one is written, its scratch tables at once."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
