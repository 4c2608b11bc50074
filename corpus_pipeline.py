"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet and reads again as the next
stage's docs. Every stage works on all rows that its predecessor kept, and all but the last return documents' columns.

An empty table gives an empty result in every stage, and extra columns pass by whatever their names (the last one's own are called
assigned_shard and assigned_slot where shard and slot are taken). Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from foliospark.llm._common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and wordless texts among them. A null lang or source is a group of its own; equal rows are judged alike; a value on a cutoff passes."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, of its equal rows one. Null, empty and wordless texts are linked with nothing and stay, as do rows without a doc_id."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their doc_id. Null, empty and wordless texts and items match nothing; equal rows go or stay together."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, by their source's rate, and shuffled. A null source is a source of its own; rows of one doc_id, null ones too, draw one count."""
    return mixing.replicate(docs).select(*(f"`{c}`" for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot in it; copies of a row are dealt like any other rows, and which takes which of their slots doesn't show."""
    return sharding.assign(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("source_mixing", mix), ("sharding", shard)]

#: No SQL: pigeonhole signatures, SimHash and the drawn matrix have no counterpart there; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
