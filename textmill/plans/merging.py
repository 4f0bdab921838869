"""Merging of sub-datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.merge import document_bounds, merge_indexed, merge_samples
from textmill.operators.pack import pack
from textmill.operators.position import with_position, with_running_total
from textmill.operators.split import split
from textmill.plans.tables import draw_sql, md5_key, table
from textmill.plans.tokens import _SHOWN, _WORD_DOCS, WORD_LENGTH, _samples, printed, word_tokens
from textmill.sinks.write import write_shards, write_split
from textmill.sources.corpus import read_corpus
from textmill.staging import stage, staging_root

TURN_PARTS = 3
SIDE_PROB, SIDE_MAX, SIDE_SEED = 0.3, 1 << 40, 11


def _indexed(items: DataFrame, order: str) -> DataFrame:
    """Number the items of each dataset."""
    return with_running_total(items.withColumn("_one", F.lit(1)), "_one", order, ["dataset"], "item_idx").drop("_one")


def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered on the ids alone, then joined to the texts."""
    docs = table(spark, sf_dir, "documents")
    items = _indexed(docs.select(F.col("source").alias("dataset"), "doc_id"), "doc_id")
    return merge_indexed(items).join(docs.select("doc_id", "text"), "doc_id")


def split_then_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples are packed, split into two written sides, and each side is merged into one dataset."""
    samples = stage(printed(pack(word_tokens(spark, sf_dir), WORD_LENGTH)), "samples")
    out = f"{staging_root(spark)}/sides-{uuid.uuid4().hex}"
    write_split(split(samples, ["shard", "seq"], SIDE_PROB, SIDE_MAX, SIDE_SEED), out)
    sides = None
    for side in ("train", "valid"):
        one = read_corpus(spark, f"{out}/split={side}")
        merged = merge_samples(one).select(F.lit(side).alias("side"), "sample", "shard", "seq", "fingerprint")
        sides = merged if sides is None else sides.unionByName(merged)
    return sides


def merge_document_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of several items, spread over a few datasets."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("part_"), F.pmod("conv_id", F.lit(TURN_PARTS)).cast("string")).alias("dataset"),
        F.col("conv_id").alias("doc_idx"),
        "turn",
    )
    ordered = with_position(turns, ["dataset", "doc_idx", "turn"], name="_order")
    return document_bounds(merge_indexed(_indexed(ordered, "_order")))


def merge_shards_equals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_samples(stage(printed(pack(word_tokens(spark, sf_dir), WORD_LENGTH)), "samples"))


def shards_written_and_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{staging_root(spark)}/samples-{uuid.uuid4().hex}"
    write_shards(pack(word_tokens(spark, sf_dir), WORD_LENGTH), out)
    return merge_samples(printed(read_corpus(spark, out).withColumn("shard", F.col("shard").cast("long"))))


QUERIES = {
    "merge_offsets": merge_offsets,
    "merge_document_bounds": merge_document_bounds,
    "merge_shards_equals_whole": merge_shards_equals_whole,
    "shards_written_and_merged": shards_written_and_merged,
    "split_then_merge": split_then_merge,
}

_MERGED_SAMPLES = f"""
    with {_WORD_DOCS}, {_samples(WORD_LENGTH)}
    select row_number() over (order by shard, seq) - 1 as sample, *
    from ({_SHOWN} where n_tokens = {WORD_LENGTH})"""

ORACLES = {
    "merge_offsets": """
        select source as dataset, doc_id,
            row_number() over (partition by source order by doc_id) - 1 as item_idx,
            row_number() over (order by source, doc_id) - 1 as merged_idx, text
        from documents""",
    "split_then_merge": f"""
        with {_WORD_DOCS}, {_samples(WORD_LENGTH)},
        sided as (
            select case when cast({draw_sql(md5_key(SIDE_SEED, 'shard', 'seq'))} as double) / cast(4294967296 as double)
                < {SIDE_PROB} then 'valid' else 'train' end as side, shard, seq, fingerprint
            from samples where n_tokens = {WORD_LENGTH})
        select side, row_number() over (partition by side order by shard, seq) - 1 as sample, shard, seq, fingerprint
        from sided""",
    "merge_document_bounds": f"""
        with items as (
            select 'part_' || cast(conv_id % {TURN_PARTS} as varchar) as dataset, conv_id as doc_idx, turn
            from conversations),
        merged as (select *, row_number() over (order by dataset, doc_idx, turn) - 1 as merged_idx from items)
        select dataset, doc_idx, max(merged_idx) + 1 as end_idx from merged group by 1, 2""",
    "merge_shards_equals_whole": _MERGED_SAMPLES,
    "shards_written_and_merged": _MERGED_SAMPLES,
}
