"""Cleaning a corpus in stages; each stage's result is written as Parquet and is the next one's input.

Rules, for all stages: a null text counts as empty; rows without a doc_id take part, and never win over a row with one; rows that
repeat a doc_id are documents of their own; texts may be of any length; of ties the smallest doc_id stays; an empty table gives
an empty table; further columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup, jaccard, mixing, packing, toxicity
from fieldloom.llm.common import remove, scratch, shared_dir


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from the labels of the same rows as query op6."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more the row with the smallest
    doc_id stays. Links come from SimHash fingerprints within three bits, and each is verified on the sets; similar sets whose
    fingerprints lie farther apart come from min-hashes and are verified alike."""
    return jaccard.deduplicate(docs, width=5, share=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, dropped or cut to the words taken."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a training sequence; a repeated document has a number for each copy."""
    out = packing.pack(docs, packing.public_tokenizer())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxic_documents), ("exact_dedup", exact_duplicates), ("simhash", near_duplicates), ("mixing", mixture), ("packing", sequences)]
#: SQL can't express the trained network or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stashes goes when its result is written, and a result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
