"""Random two-way split of a sample table, and its audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.keys import DRAW_RANGE, draw32, stable_key

# The defaults of the split job.
RIGHT_PROB = 1e-3
RIGHT_MAX = 1000
SEED = 0x5EED


def right_probability(n: int, right_prob: float = RIGHT_PROB, right_max: int = RIGHT_MAX) -> float:
    """Chance of the right side: the smaller of the given chance and ``right_max`` of ``n`` rows."""
    return min(right_max / n, right_prob) if n else 0.0


def is_right(key: Sequence[str], probability: float, seed: int = SEED) -> Column:
    """One independent draw per row, a function of the seed and the row's key."""
    return draw32(stable_key(seed, *key)) / F.lit(float(DRAW_RANGE)) < F.lit(probability)


def split(
    df: DataFrame,
    key: str | Sequence[str],
    right_prob: float = RIGHT_PROB,
    right_max: int = RIGHT_MAX,
    seed: int = SEED,
    name: str = "is_right",
) -> DataFrame:
    """Mark each row's side.  Map-only after one count; the sizes are approximate by design."""
    ids = [key] if isinstance(key, str) else list(key)
    return df.withColumn(name, is_right(ids, right_probability(df.count(), right_prob, right_max), seed))


def left_side(marked: DataFrame, name: str = "is_right") -> DataFrame:
    return marked.where(~F.col(name)).drop(name)


def right_side(marked: DataFrame, name: str = "is_right") -> DataFrame:
    return marked.where(F.col(name)).drop(name)


def without(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows whose key is not in a foreign id set."""
    return df.join(ids.select(*key), list(key), "left_anti")


def only(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key is in a foreign id set (for example a set of positions)."""
    return df.join(ids.select(*key), list(key), "left_semi")


def audit_split(left: DataFrame, right: DataFrame, whole: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of counts: both sides and the whole, and how often each rule is broken.

    All three are counted by key in one pass, so equal keys are summed before the shuffle.
    """
    sides = {"left": left, "right": right, "whole": whole}
    tagged = None
    for side in sides:
        one = sides[side].select(*key, *[F.lit(int(s == side)).alias(f"in_{s}") for s in sides])
        tagged = one if tagged is None else tagged.unionByName(one)
    per_key = tagged.groupBy(*key).agg(*[F.sum(f"in_{s}").alias(f"in_{s}") for s in sides])
    broken = {
        "n_in_both": (F.col("in_left") > 0) & (F.col("in_right") > 0),
        "n_missing": (F.col("in_whole") > 0) & (F.col("in_left") + F.col("in_right") == 0),
        "n_foreign": (F.col("in_whole") == 0),
        "n_repeated": (F.col("in_left") > 1) | (F.col("in_right") > 1),
        "n_miscounted": (F.col("in_left") + F.col("in_right") != F.col("in_whole")),
    }

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))

    return per_key.agg(
        *[total(F.col(f"in_{s}")).alias(f"n_{s}") for s in sides],
        *[total(rule).alias(label) for label, rule in broken.items()],
    )
