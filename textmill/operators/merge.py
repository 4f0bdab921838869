"""Merging sub-datasets: as a rule only offsets move, and no sample is shuffled to be renumbered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.position import before, with_running_total
from textmill.staging import stage, stage_summary


def append_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of parts that must agree in column names and types."""
    if not parts:
        raise ValueError("nothing to merge: no sub-dataset was given")
    first = {f.name: f.dataType for f in parts[0].schema.fields}
    merged = parts[0]
    for other in parts[1:]:
        if {f.name: f.dataType for f in other.schema.fields} != first:
            raise ValueError(
                f"sub-datasets differ in type: {parts[0].schema.simpleString()} and {other.schema.simpleString()}"
            )
        merged = merged.unionByName(other)
    return merged


def part_offsets(df: DataFrame, part_col: str) -> DataFrame:
    """``(part, n_items, item_offset)``: items in all parts that come earlier by name.

    One row per sub-dataset; the data is only counted.
    """
    counts = df.groupBy(part_col).agg(F.count("*").alias("n_items"))
    offsets = counts.select(part_col, "n_items", before("n_items", [], [part_col]).alias("item_offset"))
    return stage_summary(offsets, "parts")


def merge_samples(df: DataFrame, part_col: str = "shard", seq_col: str = "seq", name: str = "sample") -> DataFrame:
    """Number packed samples 0, 1, 2, ... in the order of their shard and ``seq``.

    Give written samples: they are counted by shard first, which reads two columns.  If ``seq`` runs
    0, 1, 2, ... in every shard, a sample's number is a sum.  A side of a split has gaps; then the
    samples are ranked on ``(shard, seq)`` alone, and the ranks joined to the data.
    """
    counts = df.groupBy(part_col).agg(
        F.count("*").alias("n_items"),
        F.count_distinct(seq_col).alias("_seqs"),
        F.min(seq_col).alias("_first"),
        F.max(seq_col).alias("_last"),
    )
    parts = stage(
        counts.withColumn("item_offset", before("n_items", [], [part_col])), "parts"
    )
    dense = (F.col("_first") == 0) & (F.col("_last") + 1 == F.col("n_items")) & (F.col("_seqs") == F.col("n_items"))
    offsets = stage_summary(parts.select(part_col, "item_offset"), "offsets")
    if parts.where(~dense).isEmpty():
        return df.join(offsets, part_col).select((F.col("item_offset") + F.col(seq_col)).alias(name), *df.columns)
    repeated = parts.where(F.col("_seqs") < F.col("n_items")).select(part_col).first()
    if repeated is not None:
        raise ValueError(f"{part_col} {repeated[0]} has a sample number twice")
    keys = df.select(part_col, seq_col, F.lit(1).alias("_one"))
    ranks = with_running_total(keys, "_one", seq_col, [part_col], "_rank").drop("_one")
    numbered = ranks.join(offsets, part_col).select(part_col, seq_col, (F.col("item_offset") + F.col("_rank")).alias(name))
    return df.join(numbered, [part_col, seq_col]).select(name, *df.columns)


def merge_indexed(
    parts: Sequence[DataFrame] | DataFrame,
    part_col: str = "dataset",
    item_col: str = "item_idx",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Merge indexed datasets in name order: every item index is moved by the items before.

    ``merged_idx`` is the item's index in the merged dataset.  ``counts`` gives ``(part, n_items)`` if
    they are known, from footers for instance; else the items are counted.
    """
    items = parts if isinstance(parts, DataFrame) else append_parts(parts)
    if counts is None:
        offsets = part_offsets(items, part_col).select(part_col, "item_offset")
    else:
        offsets = stage_summary(counts.select(part_col, before("n_items", [], [part_col]).alias("item_offset")), "parts")
    return items.join(offsets, part_col).select(
        *items.columns, (F.col("item_offset") + F.col(item_col)).alias("merged_idx")
    )


def document_bounds(merged: DataFrame, part_col: str = "dataset", doc_col: str = "doc_idx") -> DataFrame:
    """Document index of a merged dataset: where each document ends (first item after it).

    Together with one leading 0 for the whole these are the boundaries; the parts' own
    leading zeros vanish.
    """
    return merged.groupBy(part_col, doc_col).agg((F.max("merged_idx") + 1).alias("end_idx"))


def boundaries(merged: DataFrame, part_col: str = "dataset", doc_col: str = "doc_idx") -> DataFrame:
    """The document index of the whole: a leading 0, then the end of every document."""
    ends = document_bounds(merged, part_col, doc_col)
    zero = ends.sparkSession.range(1).select(
        *[F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in (part_col, doc_col)], F.col("id").alias("end_idx")
    )
    return zero.unionByName(ends)
