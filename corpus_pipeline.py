"""From raw documents to training shards: five stages, each a corpus operator on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.llm import decontaminate, jaccard, mixing, quality, sharding
from traceaudit.llm.common import stored, table

KEEP_FROM = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones, does not reject."""
    names = docs.columns
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model, "_quality").filter(F.col("_quality") >= KEEP_FROM).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as a mix of the sources by weight reads them, repeated where a source is short of its target."""
    return mixing.mixed_documents(docs, mixing.word_count(F.col("text")))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document in 40 shards of nearly equal bytes."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", place_in_shards),
]

# A fitted classifier and components of near duplicates have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what one stage returns is stored and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
