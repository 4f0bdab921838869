"""Closed forms that map an index to a shard, and names made from indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def int_div(a: Column | int, b: Column | int) -> Column:
    """Integer quotient of longs; exact where double division would round."""
    return F.call_function("div", as_long(a), as_long(b))


def stride_shard(index: Column, n: int) -> Column:
    """Round robin: index ``i`` goes to shard ``i mod n``."""
    return F.pmod(index, F.lit(n)).cast("long")


def ceil_block(index: Column, total: Column | int, n: int) -> Column:
    """Contiguous blocks of ``ceil(total / n)``; late shards may stay empty."""
    size = F.greatest(int_div(as_long(total) + (n - 1), n), as_long(1))
    return int_div(index, size)


def even_chunk(index: Column, total: Column | int, n: int) -> Column:
    """Contiguous chunks whose sizes differ by at most one, the longer ones first."""
    short = int_div(total, n)
    n_longer = F.pmod(as_long(total), as_long(n))
    edge = n_longer * (short + 1)
    beyond = n_longer + int_div(index - edge, F.greatest(short, as_long(1)))
    return F.when(index < edge, int_div(index, short + 1)).otherwise(beyond)


def numbered_name(base: str, index: Column, total: Column | int) -> Column:
    """``base_007``: the index zero-padded to as many digits as the total has."""
    width = F.length(as_long(total).cast("string"))
    return F.concat(F.lit(base + "_"), F.lpad(index.cast("string"), width, F.lit("0")))
