"""Corpus clean-up: toxicity, line dedup, near-dedup, decontamination, token counts.

Every stage reads what the one before wrote.  An empty table, null texts and repeated rows
pass through as each stage's operator states; rows without a ``doc_id`` stay, as no
stage can tell what they repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import bpe, decontam, linededup, neardup, toxicity
from packetloom.llm.common import arrow_rows, scratch, table
from packetloom.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic, by the threshold of their language, go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document holds first are taken out, and ``n_chars`` counted anew.

    Copies of whole documents are left to the next stage; documents that had nothing else go.
    """
    left = linededup.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with their count and a digest of what they decode to."""
    ids = bpe.encode(docs, tokenizer_path())
    return bpe.decode(ids, tokenizer_path()).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("line dedup", dedup_lines), ("near dedup", dedup_documents),
          ("decontamination", decontaminate), ("encoding", encode)]

BATCH_ROWS = 1000  # texts that Python gets at a time

# Training, sketches and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and the next reads what was written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        with arrow_rows(spark, BATCH_ROWS):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
