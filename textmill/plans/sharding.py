"""Sharding of rows and of files (the ``source`` of a document stands for its file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.chunks import numbered_name
from textmill.operators.position import with_scan_position
from textmill.operators.sharding import assign_shard, file_table
from textmill.plans.tables import NUMBERED, table
from textmill.staging import stage_summary

ROW_SHARDS = 7
FILE_SHARDS = 6


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scan_position(table(spark, sf_dir, "documents"))


def _by_file(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = stage_summary(assign_shard(file_table(docs, "source"), FILE_SHARDS, how, pos="file_idx"), "files")
    return docs.join(files, "source").select(*docs.columns, "file_idx", "shard")


def shard_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shard(_positions(spark, sf_dir), ROW_SHARDS, "stride")


def shard_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shard(_positions(spark, sf_dir), ROW_SHARDS, "chunks")


def shard_blocks_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_file(spark, sf_dir, "blocks")


def shard_round_robin_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_file(spark, sf_dir, "stride")


def output_prefix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_table(table(spark, sf_dir, "documents"), "source")
    return files.withColumn("output", numbered_name("corpus", F.col("file_idx"), files.count()))


QUERIES = {
    "shard_round_robin": shard_round_robin,
    "shard_array_split": shard_array_split,
    "shard_blocks_ceil": shard_blocks_ceil,
    "shard_round_robin_files": shard_round_robin_files,
    "output_prefix_names": output_prefix_names,
}

_FILES = """
    files as (
        select source, row_number() over (order by source) - 1 as file_idx, count(*) over () as n
        from (select distinct source from documents))"""

ORACLES = {
    "shard_round_robin": f"with {NUMBERED} select *, pos % {ROW_SHARDS} as shard from numbered",
    "shard_array_split": f"""
        with {NUMBERED},
        sized as (select count(*) // {ROW_SHARDS} as q, count(*) % {ROW_SHARDS} as r from documents)
        select numbered.*,
            case when pos < r * (q + 1) then pos // (q + 1)
                else r + (pos - r * (q + 1)) // greatest(q, 1) end as shard
        from numbered, sized""",
    "shard_blocks_ceil": f"""
        with {_FILES}
        select documents.*, file_idx,
            cast(file_idx // cast(ceil(n / {FILE_SHARDS}.0) as bigint) as bigint) as shard
        from documents join files using (source)""",
    "shard_round_robin_files": f"""
        with {_FILES}
        select documents.*, file_idx, file_idx % {FILE_SHARDS} as shard
        from documents join files using (source)""",
    "output_prefix_names": f"""
        with {_FILES}
        select file_idx, source,
            'corpus_' || lpad(cast(file_idx as varchar), cast(length(cast(n as varchar)) as integer), '0') as output
        from files""",
}
