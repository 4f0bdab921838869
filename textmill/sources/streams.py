"""Catalogue of named streams: ``<root>/stream=<name>/split=<split>``."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.chunks import as_long
from textmill.session import small_table


def read_streams(
    spark: SparkSession, root: str, split: str | None = None, streams: Sequence[str] | None = None
) -> DataFrame:
    """One scan of the root; choices of stream and split prune its partitions."""
    df = spark.read.parquet(root)
    if split is not None:
        df = df.where(F.col("split") == split)
    if streams is not None:
        df = df.where(F.col("stream").isin(list(streams)))
    return df


def catalogue_counts(
    df: DataFrame, streams: Sequence[str], stream_col: str = "stream", keep_empty: bool = False
) -> DataFrame:
    """``(stream, n_samples)`` for the catalogue's streams; empty ones are left out."""
    names = small_table(df.sparkSession, [(s,) for s in streams], [stream_col], [pa.string()])
    counts = df.groupBy(stream_col).agg(F.count("*").alias("_n"))
    sized = names.join(counts, stream_col, "left").select(
        stream_col, F.coalesce("_n", as_long(0)).alias("n_samples")
    )
    return sized if keep_empty else sized.where(F.col("n_samples") > 0)
