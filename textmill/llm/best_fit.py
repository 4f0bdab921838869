"""Best-fit packing of documents into bins of fixed size, with conflicts.

A bin holds at most one piece of a source and at most one of a cluster of duplicates.  Pieces are
taken from long to short; open bins are kept in order of the room they have left, and carry a
bitmap of their sources and one of their clusters.  The search starts at the tightest bin that has
room and goes on to its successors until a bin without a conflict is found, or a new one is opened.

Documents are dealt to groups by a hash of their id.  A group holds about ``group_bins`` bins'
worth of tokens however large the data, and is packed by one task; hot sources and large clusters
spread over all groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.staging import stage

CAPACITY = 2048
GROUP_BINS = 256
_LOCAL_BITS = 24


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1
    ).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def pack(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` for each item ``(length, source, cluster)``, in the given order.

    A null source or cluster conflicts with nothing.
    """
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    source_bits: dict[object, int] = {}
    cluster_bits: dict[object, int] = {}
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        s = 0 if source is None else 1 << source_bits.setdefault(source, len(source_bits))
        c = 0 if cluster is None else 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(room, (length, -1))
        while at < len(room) and (sources[room[at][1]] & s or clusters[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            left, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[bin_] |= s
        clusters[bin_] |= c
        placed.append((bin_, capacity - left))
        if left > length:
            insort(room, (left - length, bin_))
    return placed


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
    items = list(zip(*(table[c].to_pylist() for c in ("n_tokens", "source", "cluster"))))
    placed = pack(items, capacity)
    group = table["group"][0].as_py()
    return pa.table(
        [
            table["doc_id"],
            table["piece"],
            table["n_tokens"],
            pa.array([(group << _LOCAL_BITS) + b for b, _ in placed], pa.int64()),
            pa.array([o for _, o in placed], pa.int64()),
        ],
        names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"],
    )


def best_fit(items: DataFrame, capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """``(doc_id, piece, n_tokens, bin_id, bin_offset)`` for items ``(doc_id, source, cluster, n)``.

    An item longer than a bin is cut into pieces: full ones, and a last one with the rest.  An item
    without tokens gets one row without a bin.  Repeated items are packed as often.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    total = items.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // (capacity * group_bins)))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    pieces = items.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "doc_id",
        "source",
        "cluster",
        "piece",
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).alias("n_tokens"),
    )
    group = F.pmod(F.xxhash64("doc_id", "piece", F.lit("bin")), F.lit(groups)).alias("group")
    packed = (
        pieces.where("n_tokens > 0")
        .select("*", group)
        .groupBy("group")
        .applyInArrow(
            lambda t: _pack_group(t, capacity), "doc_id long, piece int, n_tokens long, bin_id long, bin_offset long"
        )
    )
    empty = pieces.where("n_tokens = 0").select(
        "doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset")
    )
    return packed.unionByName(empty)


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    capacity: int = CAPACITY,
    group_bins: int = GROUP_BINS,
) -> DataFrame:
    """Packs whole texts, measured in words; equal texts are a cluster of duplicates.

    Null and empty texts get a row without a bin; a null source conflicts with nothing.  Other
    columns are not read.  Only ids, lengths and hashes are shuffled.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    items = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(value).alias("cluster"),
        word_count(value).alias("n"),
    )
    return best_fit(stage(items, "lengths"), capacity, group_bins)
