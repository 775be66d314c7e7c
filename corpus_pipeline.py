"""From raw documents to shards: the stages of a training corpus, one after the other.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has
kept, and returns the columns of documents; the last returns the shards' table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, jaccard, language, mixing, sharding
from vellum.llm.base import save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language that the corpus's labelled rows teach.

    Null and empty texts and those without a letter go, and texts that share next to no n-gram with the landmarks.  Where no row
    can train a model, every text with a letter stays.  Long texts are read whole, repeated rows judged alike and other columns, of any name,
    kept; an empty table gives an empty one.
    """
    return language.in_known_languages(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones.

    The one of least doc_id stays, null last; among several of that doc_id the text of least hash; of repeated rows one.  Null and empty
    texts are similar to nothing and stay.  Long texts are compared whole, other columns, of any name, kept; an empty table gives an empty one.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark.

    Null and empty texts hold nothing of it and stay.  Long texts are searched whole, repeated rows judged alike, other columns, of
    any name, kept; an empty table gives an empty one, and an empty benchmark drops nothing.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their target weights.

    Documents without words, null and empty texts among them, go.  A document stays as often as the mix takes it, twice at most;
    rows alike in doc_id, source and text equally often.  Long texts are counted whole, other columns, of any name, kept; a null source is one of
    its own; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix.

    Null texts have size 1, a null doc_id the key ""; copies and repeated rows share a shard and have slots of their own; long texts are
    read whole; other columns are not read; an empty table gives an empty one.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Language identification fits a model, which SQL can't express; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
