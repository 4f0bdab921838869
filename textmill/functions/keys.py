"""Seeded, layout-independent random keys.

A key is the MD5 of the seed and the row's identity, so the order it gives does not
depend on file splits, partition counts or retries, unlike ``rand(seed)``.  Its leading
32 bits are uniform, which gives equal buckets without sampling the data first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def stable_key(seed: int, *ids: Column | str) -> Column:
    """32 hex digits from ``seed`` and the identifying columns."""
    return F.md5(F.concat_ws(":", F.lit(str(int(seed))), *[_col(c).cast("string") for c in ids]))


def draw32(key: Column | str) -> Column:
    """The key's first 32 bits as a long in ``[0, 2**32)``.

    A key is never null; saying so spares joins a null check that would compute it again.
    """
    return F.coalesce(F.conv(F.substring(_col(key), 1, 8), 16, 10).cast("long"), F.lit(0).cast("long"))


def bucket_of(key: Column | str, n: int) -> Column:
    """Bucket ``0..n-1``; ordered like the keys, so bucket order is key order."""
    return F.shiftright(draw32(key) * F.lit(int(n)).cast("long"), 32).cast("int")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
