"""A training corpus in five stages over ``documents``: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again before the next one starts.
All but the last return the columns of their docs, whatever else these are called. Rows with a null or letterless text go in the first stage; a null id is no document of
another row: such rows are never near-duplicates and each counts for itself. Repeated rows of one id stay or go together. Empty tables give no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontam, langid, lines, near_dup, packing
from strandlake.llm.common import sent_if_small, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model refuses: without letters, unlikely in every language, or of stranger subwords than held-out ones."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return langid.keep_accepted(docs, langid.fit_language_model(docs.where(fold != 2)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of texts; a document stays even if all its lines go. Its number of characters follows its text."""
    return lines.rewrite_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id. Shingles of five words, similarity 0.8."""
    gone = written(near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(sent_if_small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words are in windows of benchmark items."""
    return decontam.overlap(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids by power-of-two decomposition, each with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=200_000, keep_words=False, at_once=1_000_000)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Language identification and tokenization aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
