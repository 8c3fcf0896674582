"""Corpus pipeline: the stages that turn `documents` into packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  What a stage returns is written as Parquet and read again as the next
one's docs, so a lost executor never sends work back beyond one stage.

Cases, for every stage: null texts count as empty ones, and a null id is no id; an empty table gives an empty one;
further columns go through unchanged, whatever their names; a very long text is worked on whole.  Each stage says
what it does with ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netframe.llm import exact_dedup, simhash, substring_dedup, toxicity
from netframe.llm.common import fresh_dir
from netframe.llm.packing import pack_documents
from netframe.llm.queries import tokenizer_file


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier scores 0.5 or more; repeated rows share their fate."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space stays.

    It is the one with most code points, of those the one with the smallest id, of repeated rows the first.
    """
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each document whose five-word shingles are similar to 0.8 or more to one with a smaller id.

    SimHash blocks thin the groups out, a join over shingles compares what is left, the shingles decide.  Texts
    without words are alike; rows without an id stay, and repeated rows of one id stay or go together.
    """
    return simhash.drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a 13-word window that starts in a document with a smaller id too are cut out of the texts.

    Rows of one id do not cut each other, rows without an id neither cut nor are cut.
    """
    return substring_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with the sequence and the place they are packed into; repeated rows are packed each."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]

#: Training, token ids and packing are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
