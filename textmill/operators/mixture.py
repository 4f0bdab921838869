"""Mixing named streams into epochs, evaluation groups, batches and token budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.config import EvalGroup, StreamPlan, check_shares, normalised, plan_mixture
from textmill.functions.chunks import as_long, int_div
from textmill.functions.keys import bucket_of, stable_key
from textmill.operators.copies import emit_copies
from textmill.operators.position import before, with_hash_position
from textmill.session import small_table

# Hash buckets a stream is counted in: at least so many, and one for so many of its rows.
CUT_BUCKETS = 4096
CUT_ROWS = 1 << 15


def stream_counts(df: DataFrame, streams: Sequence[str], stream_col: str = "stream") -> dict[str, int]:
    """Samples per catalogue stream; at most as many rows come back as the catalogue has."""
    known = df.where(F.col(stream_col).isin(list(streams)))
    return {r[0]: r[1] for r in known.groupBy(stream_col).count().collect()}


def mixture_plan(
    df: DataFrame, shares: Mapping[str, float], size: int, stream_col: str = "stream"
) -> list[StreamPlan]:
    """Plan an epoch by proportions, which must add up to 1."""
    check_shares(shares)
    return plan_mixture(stream_counts(df, list(shares), stream_col), shares, size)


def blend_plan(df: DataFrame, weights: Mapping[str, float], size: int, stream_col: str = "stream") -> list[StreamPlan]:
    """The same from weights of any positive sum."""
    return mixture_plan(df, normalised(weights), size, stream_col)


def plan_table(df: DataFrame, plans: Sequence[StreamPlan], stream_col: str = "stream") -> DataFrame:
    """The plan as a table; one row per catalogue stream."""
    rows = [(p.stream, p.available, p.needed, p.full_copies, p.remainder) for p in plans]
    names = [stream_col, "n_available", "n_needed", "full_copies", "remainder"]
    return small_table(df.sparkSession, rows, names, [pa.string()] + [pa.int64()] * 4)


def mix(
    df: DataFrame, plans: Sequence[StreamPlan], seed: int, id_col: str, stream_col: str = "stream"
) -> DataFrame:
    """Rows of the epoch: every row ``full_copies`` times, the first ``remainder`` rows of the
    stream's stable order once more.  Adds ``copy``.

    The data itself is not shuffled, unless the plan repeats a small stream very often (see
    :func:`textmill.operators.copies.emit_copies`).  The last row that belongs to a stream's remainder is
    found first, from counts per hash bucket and an exact rank inside the one bucket where
    the remainder ends; these cuts (one per stream) become part of the plan, so each row knows
    its number of copies by itself, however often the result is evaluated.
    """
    plan = F.broadcast(plan_table(df, plans, stream_col))
    keyed = df.withColumn("_key", stable_key(seed, stream_col, id_col))
    buckets = max([CUT_BUCKETS, *(-(-p.available // CUT_ROWS) for p in plans)])
    ids = keyed.select(stream_col, id_col, "_key", bucket_of("_key", buckets).alias("_bucket"))
    wanted = plan.select(stream_col, "remainder").where(F.col("remainder") > 0)
    cuts = _remainder_cuts(ids, wanted, id_col, stream_col).toArrow()
    cut = F.broadcast(df.sparkSession.createDataFrame(cuts))
    place = F.struct(F.col("_key"), F.col(id_col).alias("_id"))
    extra = F.coalesce((place <= F.col("_last")).cast("long"), as_long(0))
    counted = (
        keyed.join(plan.select(stream_col, "full_copies"), stream_col)
        .join(cut, stream_col, "left")
        .withColumn("_copies", F.col("full_copies") + extra)
        .where(F.col("_copies") > 0)
    )
    most = max((p.full_copies + 1 for p in plans), default=1)
    return emit_copies(counted.select(*df.columns, "_copies"), "_copies", [stream_col, id_col], most)


def _remainder_cuts(ids: DataFrame, wanted: DataFrame, id_col: str, stream_col: str) -> DataFrame:
    """``(stream, _last)``: key and id of the last row inside each stream's remainder.

    One row per stream that has a remainder.
    """
    counts = ids.groupBy(stream_col, "_bucket").agg(F.count("*").alias("_n"))
    ends = (
        counts.withColumn("_earlier", before("_n", [stream_col], ["_bucket"]))
        .join(wanted, stream_col)
        .where((F.col("_earlier") < F.col("remainder")) & (F.col("remainder") <= F.col("_earlier") + F.col("_n")))
        .select(stream_col, "_bucket", (F.col("remainder") - F.col("_earlier")).alias("_keep"))
    )
    in_bucket = ids.join(F.broadcast(ends), [stream_col, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(stream_col).orderBy("_key", id_col))
    last = F.struct(F.col("_key"), F.col(id_col).alias("_id")).alias("_last")
    return in_bucket.withColumn("_rank", rank).where(F.col("_rank") == F.col("_keep")).select(stream_col, last)


def cyclic_pass(df: DataFrame, needed: int, available: int, pos: str = "pos") -> DataFrame:
    """Go round the samples until ``needed`` rows are there; adds ``copy`` and ``cycle_pos``.

    Each row works out from its position how often the pass comes by.
    """
    times = int_div(as_long(needed - 1) - F.col(pos), available) + 1
    rows = df.where(F.col(pos) < needed).withColumn("_times", times)
    passes = emit_copies(rows, "_times", [pos], most=-(-needed // max(available, 1)))
    return passes.withColumn("cycle_pos", F.col("copy") * as_long(available) + F.col(pos))


def repeat_streams(
    df: DataFrame, repeats: Mapping[str, int], stream_col: str = "stream"
) -> DataFrame:
    """Every row of a stream as often as the stream's repeat factor says; adds ``copy``."""
    table = small_table(
        df.sparkSession, sorted(repeats.items()), [stream_col, "_repeat"], [pa.string(), pa.int64()]
    )
    repeated = df.join(F.broadcast(table.where(F.col("_repeat") > 0)), stream_col)
    return emit_copies(repeated.select(*df.columns, "_repeat"), "_repeat", df.columns, max(repeats.values(), default=0))


def shuffled_positions(
    mixed: DataFrame, seed: int, ids: Sequence[str], epoch: int = 0, n: int | None = None
) -> DataFrame:
    """Put mixed rows into the epoch's random order; adds ``pos``."""
    keyed = mixed.withColumn("_key", stable_key(seed, F.lit(epoch), *ids))
    return with_hash_position(keyed, "_key", ids, n).drop("_key")


def batches(df: DataFrame, size: int, drop_last: bool, pos: str = "pos", total: int | None = None) -> DataFrame:
    """Add the batch number; ``drop_last`` leaves an incomplete last batch out."""
    total = (df.count() if total is None else total) if drop_last else None
    rows = df.where(F.col(pos) < total // size * size) if drop_last else df
    return rows.withColumn("batch", int_div(F.col(pos), size))


def group_members(df: DataFrame, groups: Sequence[EvalGroup], stream_col: str = "stream") -> DataFrame:
    """``(label, stream, repeat)`` of the configured groups."""
    table = small_table(
        df.sparkSession,
        [(g.label, list(g.streams), g.repeat) for g in groups if g.repeat > 0],
        ["label", "streams", "repeat"],
        [pa.string(), pa.list_(pa.string()), pa.int64()],
    )
    return table.select("label", F.explode("streams").alias(stream_col), "repeat")


def eval_groups(df: DataFrame, groups: Sequence[EvalGroup], stream_col: str = "stream") -> DataFrame:
    """The samples of every evaluation group; a sample comes once per group that has its stream."""
    members = F.broadcast(group_members(df, groups, stream_col))
    most = max((g.repeat for g in groups), default=0)
    return emit_copies(df.join(members, stream_col), "repeat", ["label", *df.columns], most)


def eval_group_sizes(
    df: DataFrame, groups: Sequence[EvalGroup], tokens_col: str, stream_col: str = "stream"
) -> DataFrame:
    """Samples and tokens per group.  Streams are counted once, before they meet the groups;
    a group whose streams are all empty does not appear."""
    per_stream = df.groupBy(stream_col).agg(
        F.count("*").alias("_samples"), F.sum(tokens_col).cast("long").alias("_tokens")
    )
    sized = per_stream.join(group_members(df, groups, stream_col), stream_col)
    return sized.groupBy("label").agg(
        F.count("*").alias("n_streams"),
        F.sum(F.col("_samples") * F.col("repeat")).alias("n_samples"),
        F.sum(F.col("_tokens") * F.col("repeat")).alias("n_tokens"),
    )


def token_budget(
    df: DataFrame, shares: Mapping[str, float], budget: int, tokens_col: str, stream_col: str = "stream"
) -> DataFrame:
    """Per stream: tokens there, tokens the budget asks for, and passes over the stream.

    ``budget`` is steps x batch x length of a run.
    """
    table = small_table(
        df.sparkSession, sorted(shares.items()), [stream_col, "proportion"], [pa.string(), pa.float64()]
    )
    held = df.groupBy(stream_col).agg(F.sum(tokens_col).cast("long").alias("n_tokens"))
    needed = F.col("proportion") * F.lit(float(budget))
    return table.join(held, stream_col, "left").select(
        stream_col,
        F.coalesce("n_tokens", as_long(0)).alias("n_tokens"),
        F.round(needed).cast("long").alias("n_needed"),
        F.try_divide(needed, F.col("n_tokens")).alias("passes"),
    )

