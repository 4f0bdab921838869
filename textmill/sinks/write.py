"""Sinks.  None of them reorders or re-partitions what it is given unless it says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.chunks import even_chunk, int_div, numbered_name
from textmill.sources.files import exists
from textmill.staging import stage

# The formats a corpus is written in, with each one's default codec.
DEFAULT_CODEC = {"parquet": "zstd", "json": "gzip"}


# Where an epoch laid out in ranges keeps a range's first position, and the table of their bounds.
RANGE_COL, BOUNDS = "first_pos", "_bounds"

# Directories that an epoch is laid out in at most.
MAX_RANGES = 256


def codec_name(codec: str | None, fmt: str = "parquet") -> str:
    """Codec option of a writer: ``''`` and ``none`` mean uncompressed, ``None`` the default."""
    if codec is None:
        return DEFAULT_CODEC[fmt]
    return "none" if codec in ("", "none") else codec


def write_corpus(
    df: DataFrame, out: str, fmt: str = "parquet", codec: str | None = None, mode: str = "overwrite"
) -> None:
    """One file per partition of ``df``."""
    if fmt not in DEFAULT_CODEC:
        raise ValueError(f"cannot write {fmt}; choose one of {', '.join(DEFAULT_CODEC)}")
    df.write.mode(mode).option("compression", codec_name(codec, fmt)).format(fmt).save(out)


def _compacted(df: DataFrame, column: str, compact: bool) -> DataFrame:
    """With ``compact``: rebalanced by the output column.  That is one more exchange of the data;
    it keeps the files few and lets an output much larger than the others be written by several
    tasks.  Without it every task writes a file per output it holds rows of."""
    return df.hint("rebalance", F.col(column)) if compact else df


def write_shards(
    df: DataFrame, out: str, shard_col: str = "shard", codec: str | None = None, compact: bool = True
) -> None:
    """One sub-directory per shard."""
    rows = _compacted(df, shard_col, compact)
    rows.write.mode("overwrite").option("compression", codec_name(codec)).partitionBy(shard_col).parquet(out)


def in_order(df: DataFrame, pos: str, total: int, n_files: int) -> DataFrame:
    """Partitions of consecutive positions, sizes differing by at most one row, each sorted.

    ``pos`` is dense (0..total-1), so the ranges are known and no sampling pass is needed.
    """
    part = even_chunk(F.col(pos), total, n_files).cast("int")
    return df.repartitionById(n_files, part).sortWithinPartitions(pos)


def refuse_existing(spark: SparkSession, root: str, splits: Sequence[str]) -> None:
    """Fail if the output root already holds one of the splits."""
    present = [s for s in splits if exists(spark, f"{root}/{s}") or exists(spark, f"{root}/split={s}")]
    if present:
        raise ValueError(f"{root} already holds {', '.join(present)}")


def write_split(
    marked: DataFrame,
    root: str,
    left: str = "train",
    right: str = "valid",
    flag: str = "is_right",
    codec: str | None = None,
) -> None:
    """Both sides of a split in one pass, as ``split=<name>`` below the root."""
    refuse_existing(marked.sparkSession, root, [left, right])
    named = marked.withColumn("split", F.when(F.col(flag), right).otherwise(left)).drop(flag)
    named.write.mode("append").option("compression", codec_name(codec)).partitionBy("split").parquet(root)


def write_split_paths(
    marked: DataFrame, left_path: str, right_path: str, flag: str = "is_right", codec: str | None = None
) -> None:
    """The two sides under paths of their own; the mark is a function of the row, so both reads agree."""
    for path, side in ((left_path, ~F.col(flag)), (right_path, F.col(flag))):
        marked.where(side).drop(flag).write.mode("errorifexists").option(
            "compression", codec_name(codec)
        ).parquet(path)


def write_per_file(
    df: DataFrame,
    out: str,
    base: str,
    n_files: int,
    file_idx: str = "file_idx",
    key: str | None = None,
    compact: bool = True,
) -> None:
    """One sub-directory per input file, ``output=<base>_<padded index>[_<key>_document]``."""
    name = numbered_name(base, F.col(file_idx), n_files)
    if key is not None:
        name = F.concat(name, F.lit(document_suffix(key)))
    rows = _compacted(df.withColumn("output", name), "output", compact)
    rows.write.mode("overwrite").partitionBy("output").parquet(out)


def document_suffix(key: str = "text") -> str:
    """Ending of the datasets made from one text key."""
    return f"_{key}_document"


def write_epochs(order: DataFrame, out: str, range_rows: int | None = None) -> None:
    """Keep computed epoch orders, one directory per epoch.

    With ``range_rows`` an epoch is laid out in directories of so many consecutive positions, whose bounds
    are kept beside them, so that a run that resumes, or one rank of it, reads its part only
    (:func:`read_epoch_slice`).  The directories of a long epoch hold a multiple of ``range_rows``, so that
    there are no more than ``MAX_RANGES``.  The order is computed once and written, then laid out.
    """
    if range_rows is None:
        order.write.mode("errorifexists").partitionBy("epoch").parquet(out)
        return
    kept = stage(order, "epoch-order")
    last = kept.agg(F.max("pos")).first()[0] or 0
    width = range_rows * max(1, -(-(last + 1) // (range_rows * MAX_RANGES)))
    laid = kept.withColumn(RANGE_COL, int_div(F.col("pos"), width) * width)
    rows = _compacted(laid, RANGE_COL, True)
    rows.write.mode("errorifexists").partitionBy("epoch", RANGE_COL).parquet(out)
    bounds = laid.groupBy("epoch", RANGE_COL).agg(F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"))
    bounds.coalesce(1).write.mode("errorifexists").parquet(f"{out}/{BOUNDS}")


def read_epoch(spark: SparkSession, out: str, epoch: int) -> DataFrame:
    """A kept epoch order; only its directory is read."""
    kept = spark.read.parquet(out).where(F.col("epoch") == epoch)
    return kept.drop(RANGE_COL)


def rank_range(first: int, last: int, rank: int, ranks: int) -> tuple[int, int]:
    """The positions of one of ``ranks`` near-equal consecutive parts of ``[first, last)``."""
    if not 0 <= rank < ranks:
        raise ValueError(f"rank {rank} is none of {ranks}")
    share, rest = divmod(max(0, last - first), ranks)
    start = first + rank * share + min(rank, rest)
    return start, start + share + (rank < rest)


def read_epoch_slice(
    spark: SparkSession, out: str, epoch: int, first: int = 0, last: int | None = None, rank: int = 0, ranks: int = 1
) -> DataFrame:
    """What one rank still has to read of an epoch from position ``first`` on (up to before ``last``).

    The kept bounds say which directories hold these positions; no other is listed or opened.
    """
    mine = spark.read.parquet(f"{out}/{BOUNDS}").where(F.col("epoch") == epoch)
    end = mine.agg(F.max("last_pos") + 1).first()[0] or 0
    start, stop = rank_range(first, end if last is None else min(last, end), rank, ranks)
    held = mine.where((F.col(RANGE_COL) < stop) & (F.col("last_pos") >= start)).select(RANGE_COL).orderBy(RANGE_COL)
    folders = [f"{out}/epoch={epoch}/{RANGE_COL}={r[0]}" for r in held.collect()]
    if not folders:
        return read_epoch(spark, out, epoch).where(F.lit(False))
    kept = spark.read.option("basePath", out).parquet(*folders).drop(RANGE_COL)
    return kept.where((F.col("pos") >= start) & (F.col("pos") < stop))
