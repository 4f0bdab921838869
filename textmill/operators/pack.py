"""Packing documents into samples of a fixed number of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import workers
from textmill.functions.chunks import int_div
from textmill.operators.cut import PIECE_BITS
from textmill.operators.position import before, with_blocks
from textmill.staging import stage

# Blocks of the no-wrap fold that one task puts together; each carries two arrays of ``length`` numbers.
FAN = 32


def pack(
    df: DataFrame,
    length: int,
    shard_col: str = "shard",
    order_col: str = "pos",
    wrap: bool = True,
    keep_tail: bool = False,
    tokens_col: str = "tokens",
    piece_col: str | None = None,
) -> DataFrame:
    """Concatenate each shard's documents in order and cut samples of ``length`` tokens.

    Returns ``(shard, seq, n_tokens, tokens)``.  The incomplete last sample of a shard is left
    out unless ``keep_tail``.  With ``wrap=False`` a document cut by a sample's end is not
    continued.  ``order_col`` is a long, unique within the shard; rows that are pieces of documents
    share it, and ``piece_col`` orders them within their document.

    Give a written table of tokens (see :func:`textmill.staging.stage`) with ``n_tokens``: the
    lengths are read before the tokens, and a tokeniser should not run twice.
    """
    if length < 1:
        raise ValueError("samples need a positive length")
    docs = df
    if "n_tokens" not in df.columns:
        docs = df.withColumn("n_tokens", F.size(tokens_col).cast("long"))
    pieces = [] if piece_col is None else [F.col(piece_col).cast("long").alias("_piece")]
    docs = docs.where(F.col("n_tokens") > 0).select(shard_col, order_col, *pieces, tokens_col, "n_tokens")
    if wrap and pieces:
        order = F.col(order_col) * (1 << PIECE_BITS) + F.col("_piece")
        docs = docs.select(shard_col, order.alias(order_col), tokens_col, "n_tokens")
    cut = _pack_wrapped if wrap else _pack_unwrapped
    samples = cut(docs, length, shard_col, order_col, tokens_col).withColumnRenamed(shard_col, "shard")
    return samples if keep_tail else samples.where(F.col("n_tokens") == length)


def _pack_wrapped(docs: DataFrame, length: int, shard: str, order: str, tokens: str) -> DataFrame:
    """Samples inside a block are built where the block is; only those across are shuffled.

    Both kinds come from the same exchange of the documents, which Spark runs once as long as
    the two plans are equal below it: so no column is renamed before.
    """
    blocked, table = with_blocks(docs, "n_tokens", order, [shard])
    keys = [shard, "_block"]
    start, end = F.col("_start"), F.col("_start") + F.col("n_tokens")
    first, beyond = F.col("seq") * length, (F.col("seq") + 1) * length
    pieces = (
        blocked.withColumn("_local", before("n_tokens", keys, [order]))
        .join(table, keys)
        .withColumn("_start", F.col("_offset") + F.col("_local"))
        .withColumn("seq", F.explode(F.sequence(int_div(start, length), int_div(end - 1, length))))
    )
    inside = (first >= F.col("_offset")) & (beyond <= F.col("_offset") + F.col("_sum"))
    lo, hi = F.greatest(start, first), F.least(end, beyond)
    part = F.slice(tokens, (lo - start + 1).cast("int"), (hi - lo).cast("int"))
    cut = [(lo - first).alias("_lo"), part.alias("_part")]
    whole = pieces.where(inside).select(*keys, "seq", *cut).groupBy(*keys, "seq").agg(*_joined())
    across = pieces.where(~inside).select(shard, "seq", *cut).groupBy(shard, "seq").agg(*_joined())
    return whole.drop("_block").unionByName(across)


def _joined() -> list[Column]:
    """Pieces of one sample, in order, as one array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_lo", "_part"))), lambda p: p["_part"])
    return [F.sum(F.size("_part")).cast("int").alias("n_tokens"), F.flatten(ordered).alias("tokens")]


def place_unwrapped(docs: DataFrame, length: int, shard: str = "shard", order: str = "pos") -> DataFrame:
    """Where each document goes if none may run across a sample's end.

    Which sample a document falls into depends on all documents before it.  Each block's
    effect on every possible fill level is worked out by itself.  Effects are maps, so those of
    neighbouring blocks are put together in a tree of fan ``FAN``; the starts then go down the
    tree, and each block is replayed from its own.  No task holds more than ``FAN`` effects,
    however long a shard is.  Only ``(shard, order, n_tokens)`` reaches Python.
    """
    sizes = docs.select(shard, order, "n_tokens")
    blocked, _ = with_blocks(sizes, "n_tokens", order, [shard])
    blocked = blocked.select(shard, "_block", order, "n_tokens")
    kind = dict(blocked.dtypes)
    head = f"`{shard}` {kind[shard]}, _block long"
    effect = f"{head}, _level array<int>, _closed array<long>"
    parent = int_div(F.col("_block"), FAN)
    effects = blocked.groupBy(shard, "_block").applyInPandas(
        lambda pdf: workers.block_transition(pdf, shard, order, length), effect
    )
    levels = [stage(effects, "effects")]
    while (levels[-1].agg(F.max("_block")).first()[0] or 0) >= FAN:
        up = levels[-1].withColumn("_parent", parent).groupBy(shard, "_parent")
        levels.append(stage(up.applyInPandas(lambda pdf: workers.compose_blocks(pdf, shard), effect), "effects"))
    zero = F.lit(0).cast("long")
    starts = levels[-1].select(shard).distinct().select(
        shard, zero.alias("_block"), zero.alias("_from"), zero.alias("_seq")
    )
    for below in reversed(levels):
        above = starts.withColumnRenamed("_block", "_parent")
        joined = below.withColumn("_parent", parent).join(above, [shard, "_parent"])
        starts = joined.groupBy(shard, "_parent").applyInPandas(
            lambda pdf: workers.chain_blocks(pdf, shard), f"{head}, _from long, _seq long"
        )
    return (
        blocked.join(starts, [shard, "_block"])
        .groupBy(shard, "_block")
        .applyInPandas(
            lambda pdf: workers.place_documents(pdf, shard, order, length),
            f"`{shard}` {kind[shard]}, `{order}` {kind[order]}, seq long, _lo long, _kept long",
        )
    )


def _pack_unwrapped(docs: DataFrame, length: int, shard: str, order: str, tokens: str) -> DataFrame:
    if "_piece" in docs.columns:
        whole = docs.groupBy(shard, order).agg(F.sum("n_tokens").cast("long").alias("n_tokens"))
        start = before("n_tokens", [shard, order], ["_piece"])
    else:
        whole, start = docs, F.lit(0).cast("long")
    placed = place_unwrapped(whole, length, shard, order)
    kept = F.least(F.col("n_tokens"), F.col("_kept") - F.col("_start"))
    pieces = (
        docs.withColumn("_start", start)
        .join(placed, [shard, order])
        .where(kept > 0)
        .select(shard, "seq", (F.col("_lo") + F.col("_start")).alias("_lo"), F.slice(tokens, F.lit(1), kept.cast("int")).alias("_part"))
    )
    return pieces.groupBy(shard, "seq").agg(*_joined())


def text_samples(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Without concatenation: one text sample per document."""
    return df.select(F.col(text_col).alias("text"))


def pack_report(docs: DataFrame, samples: DataFrame, shard_col: str = "shard") -> DataFrame:
    """Per shard: samples, tokens kept, tokens of the documents, tokens not in any sample."""
    made = samples.groupBy("shard").agg(
        F.count("*").alias("n_samples"), F.sum("n_tokens").cast("long").alias("n_packed")
    )
    size = F.col("n_tokens") if "n_tokens" in docs.columns else F.size("tokens")
    given = docs.groupBy(F.col(shard_col).alias("shard")).agg(F.sum(size).cast("long").alias("n_tokens"))
    kept = F.coalesce(F.col("n_packed"), F.lit(0).cast("long"))
    return given.join(made, "shard", "left").select(
        "shard",
        F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"),
        kept.alias("n_packed"),
        "n_tokens",
        (F.col("n_tokens") - kept).alias("n_left_over"),
    )
