"""Reading packed sample datasets, and checking that sub-datasets are complete."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import small_table
from textmill.sources.files import decoded_path, list_dir, scanned_files
from textmill.sources.footers import part_of, read_footers
from textmill.staging import stage

# The two halves of an indexed dataset.
HALVES = (".bin", ".idx")


def sample_kind(df: DataFrame) -> str:
    """``tokens`` or ``text``, from the schema alone."""
    for kind in ("tokens", "text"):
        if kind in df.columns:
            return kind
    raise ValueError(f"neither tokens nor text among {df.columns}")


def read_packed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A packed dataset and its kind; ids are read as 32-bit integers."""
    df = spark.read.parquet(path)
    kind = sample_kind(df)
    return (df.withColumn("tokens", F.col("tokens").cast("array<int>")) if kind == "tokens" else df), kind


def pair_listing(spark: SparkSession, directory: str) -> DataFrame:
    """``(prefix, ext)`` of a directory's files; sub-directories are left out."""
    names = [n for n, is_directory in list_dir(spark, directory) if not is_directory]
    rows = [(n[: n.rindex(".")], n[n.rindex(".") :]) for n in names if "." in n[1:]]
    return small_table(spark, rows, ["prefix", "ext"], [pa.string(), pa.string()])


def paired_prefixes(listing: DataFrame, halves: Sequence[str] = HALVES) -> DataFrame:
    """``(prefix, complete)``: each prefix once, and whether all halves are there."""
    found = listing.groupBy("prefix").agg(F.collect_set("ext").alias("exts"))
    wanted = F.array(*[F.lit(h) for h in halves])
    return found.select("prefix", (F.size(F.array_except(wanted, "exts")) == 0).alias("complete"))


def require_pairs(listing: DataFrame, halves: Sequence[str] = HALVES) -> DataFrame:
    """The prefixes, or an error that names an incomplete one."""
    pairs = paired_prefixes(listing, halves)
    missing = pairs.where(~F.col("complete")).select("prefix").first()
    if missing is not None:
        raise ValueError(f"{missing[0]}: one of {', '.join(halves)} is missing")
    return pairs.select("prefix")


def complete_parts(spark: SparkSession, root: str) -> list[str]:
    """Sub-datasets of a root, by name; all must have been written to the end.

    A writer marks what it has finished with ``_SUCCESS``: the root, if it wrote all parts at once,
    or each part.  An attempt that was broken off leaves ``_temporary``.
    """
    listed = list_dir(spark, root)
    parts = [n for n, is_directory in listed if is_directory and n[:1] not in "._"]
    if not parts:
        raise ValueError(f"{root}: no sub-datasets to merge")
    if any(n == "_temporary" for n, _ in listed):
        raise ValueError(f"{root}: not completely written")
    if any(n == "_SUCCESS" for n, _ in listed):
        return parts
    for part in parts:
        if not any(n == "_SUCCESS" for n, _ in list_dir(spark, f"{root}/{part}")):
            raise ValueError(f"{root}/{part}: not completely written")
    return parts


def read_parts(spark: SparkSession, root: str, part_col: str = "output") -> tuple[DataFrame, DataFrame]:
    """All sub-datasets of a root as one scan with their names, and ``(part, n_items)`` from their footers.

    Every part must have been written to the end, and all files must agree in columns and types, whatever
    the scan would make of them.  The plan has one scan, however many parts there are.
    """
    complete_parts(spark, root)
    rows = spark.read.option("recursiveFileLookup", True).parquet(root)
    paths = [uri for uri, _ in scanned_files(rows)]
    footers = stage(read_footers(spark, paths).withColumn(part_col, part_of(F.col("path"))), "footers")
    kinds = footers.groupBy("columns").agg(F.min("path").alias("path")).orderBy("path").limit(2).collect()
    if len(kinds) > 1:
        raise ValueError("sub-datasets differ in type: " + "; ".join(f"{r['path']} has {r['columns']}" for r in kinds))
    counts = footers.groupBy(part_col).agg(F.sum("n_rows").cast("long").alias("n_items"))
    named = rows.select("*", part_of(decoded_path(F.col("_metadata.file_path"))).alias(part_col))
    return named, counts
