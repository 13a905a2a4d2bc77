"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of
`docs`; the last returns each document's shard. Stages keep the operators' defined cases: null and
empty texts fail the quality rules, null ids are allowed, rows that repeat are near duplicates of
each other, empty tables stay empty and further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, jaccard_join, line_rules, mixing, queries, sharding
from tidewater.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are boilerplate of their source; copies are left to the next stage."""
    return line_rules.clean(docs, limits=line_rules.Limits(per_text=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return jaccard_join.representatives(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights for a budget of 80 per cent of the tokens, none twice."""
    return mixing.mixed(docs, mixing.by_source(), queries.WEIGHTS, 0.8)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in 40 shards of nearly equal bytes."""
    return sharding.shard_by_bytes(docs, 40)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("mixing", mixture),
    ("sharding", shards),
]
#: Decontamination and near duplicates have brute-force tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's result is a table in the shared folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
