"""A training-data pipeline: repetition rules, near-copy removal, mixing to target weights, best-fit packing.

Every stage takes documents (doc_id, text, source and any other columns) and returns rows with the same columns, the
last one pieces. An empty table gives an empty one; other columns, whatever they are called, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelake.llm import common, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go: null, empty and very short texts among them. Long texts are judged whole; repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more. It is the one with the smallest id, null ids last; of rows with equal id and text any one."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times. A null source is a source; documents without words go; rows with equal ids share what all of them are given."""
    return mixing.mixed_corpus(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 words. Documents that come several times are packed as often; of bins with equal room the older one is taken."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("mix_sources", mix_sources), ("best_fit_packing", pack)]

#: Fingerprints, components and bin search are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last keeps is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
