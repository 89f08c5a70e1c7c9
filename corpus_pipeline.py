"""From raw documents to token ids: the order is toxicity, copies, near copies, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of the stage before. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalframe.llm import exact_dedup, jaccard_join, mixing, sentencepiece, toxicity
from evalframe.llm.queries import SOURCE_WEIGHTS
from evalframe.runtime import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from their labelled part, doesn't take for toxic."""
    lexicon = toxicity.learn_by_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, lexicon).where("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.75 on five-word shingles form."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: files and rows follow it."""
    return mixing.mixed_order(mixing.mix(docs, SOURCE_WEIGHTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and place in the mixture (phase, slot, row_in_block), sorted by it.

    A scan of several files doesn't give the rows in the order they were written in, so the places are derived again.
    """
    mixed = mixing.mix(docs, SOURCE_WEIGHTS).orderBy("slot", "row_in_block")
    return sentencepiece.encode(mixed, sentencepiece.load_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", encode),
]
ORACLE_SQL = None  # SQL can't segment texts; tests hold the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; rows in the order of the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.orderBy("slot", "row_in_block")
