"""From raw documents to training shards: five stages, each a corpus operator over all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``documents``. ``run`` cuts the lineage between stages in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, neardup, quality, sharding
from quern.llm.common import cut, documents, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts."""
    return neardup.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, dealt to shards and sorted along the Hilbert curve."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one),
    ("decontamination", keep_clean),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL expresses neither the fitted classifier nor the signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
