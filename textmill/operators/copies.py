"""Emitting a row several times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.chunks import as_long, int_div
from textmill.session import shuffle_width

# Copies that a row's own task may emit.
FEW_COPIES = 64


def emit_copies(
    df: DataFrame, count: str, by: Sequence[str], most: int | None = None, name: str = "copy"
) -> DataFrame:
    """Emit each row ``count`` times (a column of longs, at least 1), numbered 0, 1, 2, ...

    A few copies are emitted in place.  A row with many is first turned into slices, about as
    many as each has copies, which are dealt out by the columns ``by`` (they identify a
    row): a handful of rows that make up a third of the result is emitted by many tasks.
    ``most`` is the largest count, if known; where it is small nothing is shuffled at all.
    """
    n = F.col(count)
    few = df if most is not None and most <= FEW_COPIES else df.where(n <= FEW_COPIES)
    in_place = few.withColumn(name, F.explode(F.sequence(as_long(0), n - 1))).drop(count)
    if few is df:
        return in_place
    first = F.col("_slice") * F.col("_size")
    sliced = (
        df.where(n > FEW_COPIES)
        .withColumn("_size", F.ceil(F.sqrt(n)).cast("long"))
        .withColumn("_slice", F.explode(F.sequence(as_long(0), int_div(n - 1, F.col("_size")))))
        .repartition(shuffle_width(df), *by, "_slice")
        .withColumn(name, F.explode(F.sequence(first, F.least(first + F.col("_size"), n) - 1)))
    )
    return in_place.unionByName(sliced.select(*in_place.columns))
