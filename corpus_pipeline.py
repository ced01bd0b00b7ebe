"""A corpus pipeline of five operators over the documents table.

Language ID rejects documents without a clear language; MinHash leaves one
document of each group of near copies; suffix-array dedup takes repeated passages
out; mixing repeats and orders documents by source; BPE encodes what is left.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm import bpe, langid, minhash_dedup, mixing, suffix_dedup
from plexgraph.llm.runtime import bounded_batches, stored
from plexgraph.llm.toxicity import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is less sure than this are rejected.
SURE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language whose mean probability is SURE at least."""
    bounded_batches(spark)
    field = langid.fit(docs.where(~held_out(parts=3, part=1)))
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"))
    return langid.predict(rows, field).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    bounded_batches(spark)
    return minhash_dedup.near_duplicates(docs).where("representative").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; a character goes only as a whole."""
    bounded_batches(spark)
    rows = suffix_dedup.remove_repeats(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by the targets of their sources, in the order of the curriculum."""
    bounded_batches(spark)
    return mixing.curriculum(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    bounded_batches(spark)
    rows = bpe.encode(docs.select(*COLUMNS))
    return rows.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language id", known_language),
    ("minhash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", mixed_sources),
    ("bpe encoding", encoded),
]

#: Trained and hashed stages have no SQL; tests hold the operators that the stages call against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
