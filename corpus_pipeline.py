"""A corpus pipeline of four stages: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one returns the
packed pieces. run() writes each stage's rows to the folder that the executors share and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import packing, quality, simhash, toxicity
from colloquy.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject. Null texts count as empty, repeated rows are judged alike, an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier doesn't reject; odd rows as for quality."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, rows without one last, then the smallest digest of the text."""
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can't express the classifiers; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
