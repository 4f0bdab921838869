"""Sharding of files and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.chunks import ceil_block, even_chunk, stride_shard
from textmill.operators.position import with_position


def assign_shard(
    df: DataFrame, n: int, how: str = "stride", pos: str = "pos", total: int | None = None, name: str = "shard"
) -> DataFrame:
    """Add the shard of each row from its dense position.

    ``stride``: round robin.  ``blocks``: contiguous blocks of ``ceil(total / n)``.
    ``chunks``: contiguous, sizes differ by at most one.  The last two need the total, which
    is counted if not given.
    """
    if n < 1:
        raise ValueError("need at least one shard")
    index = F.col(pos)
    if how == "stride":
        return df.withColumn(name, stride_shard(index, n))
    rule = {"blocks": ceil_block, "chunks": even_chunk}[how]
    return df.withColumn(name, rule(index, df.count() if total is None else total, n))


def file_table(df: DataFrame, file_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """``(file_idx, <file_col>)``: the distinct files in name order, numbered."""
    files = df.select(file_col, *extra).distinct()
    return with_position(files, [file_col, *extra], name="file_idx")
