"""List ranking and prefix sums along a list whose elements lie anywhere.

A list is a table of elements, each with a dense number and the number of the next one.  Blocks of
consecutive numbers are looked at by one task each: the stretches of the list that lie in a block become
single elements, so a list that mostly steps to near numbers shrinks a lot at once.  What is left is
ranked by pointer jumping (each round joins every element to the one it points to and doubles the
distance), or by one task once it is below ``SMALL`` elements.  Each pointer has one owner, so no join
has a hot key; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.bytesops import released
from textmill.operators.position import before
from textmill.staging import drop_tables, stage, stage_summary, staged_since, staged_so_far

BLOCK_BITS = 17
SMALL = 1 << 17


def _walk(next_: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last element and total length up to it (itself included), for lists inside one array; -1 ends one."""
    to = np.where(next_ >= 0, next_, np.arange(len(next_)))
    total = np.where(next_ >= 0, length, 0)
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to, total + length[to]
        total = total + total[to]
        to = further


def _contracted(table: pa.Table) -> pa.Table:
    """``(id, head, offset, next, length)`` of one block: the last two of first elements only."""
    ids, next_ = table["id"].to_numpy(), table["next"].fill_null(-1).to_numpy()
    order = np.argsort(ids)
    ids, next_ = ids[order], next_[order]
    place = np.searchsorted(ids, next_)
    inside = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == next_)
    local = np.where(inside, place, -1)
    last, left = _walk(local, np.ones(len(ids), np.int64))
    first = np.ones(len(ids), bool)
    first[local[inside]] = False
    heads = np.flatnonzero(first)
    of = np.empty(len(ids), np.int64)
    of[last[heads]] = heads
    head = of[last]
    beyond = next_[last]
    return pa.table(
        {
            "id": ids,
            "head": ids[head],
            "offset": left[head] - left,
            "next": pa.array(beyond, pa.int64(), mask=~first | (beyond < 0)),
            "length": pa.array(left, pa.int64(), mask=~first),
        }
    )


def _ranked(table: pa.Table) -> pa.Table:
    """The length from every element to the end of a small list."""
    ids, next_ = table["id"].to_numpy(), table["next"].fill_null(-1).to_numpy()
    order = np.argsort(ids)
    ids, next_ = ids[order], next_[order]
    local = np.where(next_ >= 0, np.searchsorted(ids, next_), -1)
    return pa.table({"id": ids, "left": _walk(local, table["length"].to_numpy()[order])[1]})


def _lengths_left(chains: DataFrame, small: int) -> DataFrame:
    """``(id, left)``: the length from an element of ``(id, next, length)`` to the end of the list."""
    if chains.count() <= small:
        return chains.groupBy(F.lit("all")).applyInArrow(released(_ranked), "id long, left long")
    spark, mark = chains.sparkSession, staged_so_far()
    current = chains.select("id", "next", F.col("length").alias("left"))
    while True:
        ahead = current.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        jumped = current.join(ahead, "next", "left").select(
            "id", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")
        )
        old = staged_since(mark)
        current = stage(jumped, "jumps")
        drop_tables(spark, old)
        mark = staged_so_far() - 1
        if not current.where("next is not null").limit(1).count():
            return current.select("id", "left")


def list_ranks(links: DataFrame, block_bits: int = BLOCK_BITS, small: int = SMALL) -> DataFrame:
    """``(id, pos)``: the place from 0 of each element of the one list in ``(id, next)``.

    Ids are dense from 0; the last element's ``next`` is null.
    """
    block = F.shiftright("id", block_bits)
    marks = stage(
        links.select("id", "next").groupBy(block).applyInArrow(
            released(_contracted), "id long, head long, offset long, next long, length long"
        ),
        "stretches",
    )
    chains = marks.where("length is not null").select("id", "next", "length")
    total = chains.agg(F.sum("length")).first()[0] or 0
    left = stage_summary(_lengths_left(chains, small).withColumnRenamed("id", "head"), "lengths")
    return marks.join(left, "head").select("id", (F.lit(total) - F.col("left") + F.col("offset")).alias("pos"))


def prefix_sums(rows: DataFrame, pos: str, values: Sequence[str], block_bits: int = 16, most: int = 1 << 20) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its sum over all rows with a smaller dense ``pos``.

    There are at most ``most`` blocks, so that their table is a bounded summary.
    """
    rows_n = rows.count()
    bits = max(block_bits, (max(rows_n - 1, 0) // most).bit_length())
    blocked = rows.withColumn("_block", F.shiftright(pos, bits))
    sums = stage(blocked.groupBy("_block").agg(*[F.sum(v).cast("long").alias(v) for v in values]), "block-sums")
    offsets = F.broadcast(sums.select("_block", *[before(v, [], ["_block"]).alias(f"_{v}") for v in values]))
    inside = Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.select(
        *[c for c in rows.columns if c not in values],
        "_block",
        *[F.coalesce(F.sum(v).over(inside), F.lit(0)).cast("long").alias(v) for v in values],
    )
    return local.join(offsets, "_block").select(
        *[(F.col(v) + F.col(f"_{v}")).alias(v) if v in values else F.col(v) for v in rows.columns]
    )
