"""From raw documents to packed training sequences, by the operators of wearstream.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearstream.llm.common import removed, written
from wearstream.llm.jaccard_join import keep_first
from wearstream.llm.mixing import mix_sources
from wearstream.llm.packing import pack_documents
from wearstream.llm.quality_model import keep_good
from wearstream.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the smallest id, of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return keep_first(docs, size=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that smaller ids have in the same 13-word passages; those left without a word go.

    Lines, tabs and spaces around the words that stay are kept.
    """
    cut = remove_repeats(docs, k=13, layout=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text"))
    fresh = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length(text).cast("long"))}
    return cut.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of their sources, mix_slot and mix_place, as files keep no order."""
    return mix_sources(docs).drop("mix_source", "mix_block", "mix_release", "mix_due")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, numbered along the mixture: tasks read ranges of its slots, and number by task."""
    return pack_documents(docs.orderBy("mix_slot", "mix_place"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture), ("packing", packed)]

#: The classifier can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet in the shared folder, read by the next and then removed."""
    docs, last = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            removed(last)
        last = docs
    return docs
