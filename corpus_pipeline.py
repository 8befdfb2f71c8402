"""The corpus pipeline: five stages, each one of the corpus operators on all that the stage before it kept.

A stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns a DataFrame; run() writes each
stage's result as Parquet and reads it back as the next one's docs. All stages but the last return docs' own columns.

Defined cases, of docs with any further columns: a null, empty or letterless text goes at language identification, and of
what is left nothing is null. Rows without a doc_id pass near-duplicate removal and are mixed and sharded like others. Rows
equal in doc_id and text are one document there, and one of them stays; several texts under one doc_id all stay. In
decontamination they go together when one of them holds an item. Equal rows that are mixed in more than once are shards' rows
of their own. Ties are broken by doc_id or by a hash of the row, so reruns agree. An empty table gives an empty result with
the same columns, as does one from which no language can be learnt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, langid, mixing, neardup, sharding
from millrace.llm._spark import written
from millrace.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid classifier accepts."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix to target weights takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and slot."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL has no nearest-centroid model or Order MinHash; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
