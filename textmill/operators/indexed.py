"""Tokenising file by file into indexed datasets."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.position import with_line_position, with_running_total, with_scan_position
from textmill.operators.tokenize import Tokenizer, tokenize
from textmill.session import is_small, small_table
from textmill.sources.corpus import read_corpus
from textmill.sources.files import decoded_path, scanned_files
from textmill.staging import stage_summary


def read_files_in_order(
    spark: SparkSession, paths: Sequence[str], fmt: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """All rows of a list of files, with ``file_idx`` (place in the list) and ``pos`` (row order).

    A file that is listed twice is read twice, under both its places.  A directory is one place: its
    files belong together, in name order.
    """
    df = read_corpus(spark, list(dict.fromkeys(paths)), fmt, schema)
    scanned = [path for path, _ in scanned_files(df)]
    if len(set(scanned)) < len(scanned):  # a file and its directory, or one file under two spellings
        df = read_corpus(spark, sorted(set(scanned)), fmt, schema)
    if fmt == "parquet":
        placed = with_scan_position(df.select("*", decoded_path(F.col("_metadata.file_path")).alias("_path")))
    else:
        placed = with_line_position(df, path_col="_path")
    located = placed.withColumn("_path", without_scheme(F.col("_path")))
    held = files_of(spark, paths, {_bare(path) for path in scanned})
    rows = [(i, name) for i, path in enumerate(paths) for name in held[path]]
    catalog = small_table(spark, rows, ["file_idx", "_path"], [pa.int64(), pa.string()])
    return located.join(catalog, "_path").drop("_path")


def files_of(spark: SparkSession, paths: Sequence[str], scanned: set[str]) -> dict[str, list[str]]:
    """The files, without a local scheme, that each path stands for; only what is no scanned file is listed again."""
    held = {}
    for path in dict.fromkeys(paths):
        if _bare(path) in scanned:
            held[path] = [_bare(path)]
        else:
            held[path] = [_bare(f) for f, _ in scanned_files(spark.read.format("binaryFile").load(path))]
    return held


def _bare(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def without_scheme(path: Column) -> Column:
    """Local paths are listed without a scheme but reported with one."""
    return F.regexp_replace(path, "^file:/+", "/")


def indexed_datasets(
    spark: SparkSession,
    paths: Sequence[str],
    tokenizer: Tokenizer,
    fmt: str = "json",
    key: str = "text",
    schema: T.StructType | str | None = None,
    eod: int | None = None,
    by_file: bool = False,
) -> DataFrame:
    """One dataset per input file or directory: ``(file_idx, item_idx, doc_idx, size, tokens)``.

    Every document is one item, numbered in file order; documents without a text make none.
    ``by_file`` brings the texts of a file together before they are tokenised, for a sink that writes a
    file's items together: texts are moved, which are a fraction of their ids.  A small input is dealt
    out to all cores instead, each of which has something of every file.
    """
    docs = read_files_in_order(spark, paths, fmt, schema).select("file_idx", "pos", F.col(key).alias("text"))
    found = docs.groupBy("file_idx").agg(
        F.min("pos").alias("_start"),
        # Rows without a text, and places that rows of other datasets take between this one's files.
        (F.count_if(F.col("text").isNull()) + F.max("pos") - F.min("pos") + 1 - F.count("*")).alias("_missing"),
    )
    starts = stage_summary(found, "file-starts")
    if starts.where(F.col("_missing") > 0).isEmpty():
        # Every row is an item: its number is its place in the file, and no text is moved.
        numbered = docs.join(starts, "file_idx").select(
            "file_idx", "pos", "text", (F.col("pos") - F.col("_start")).alias("item_idx")
        )
    else:  # a missing text takes no number; numbered as texts, which are smaller than their tokens
        counted = docs.withColumn("_item", F.col("text").isNotNull().cast("long"))
        numbered = with_running_total(counted, "_item", "pos", ["file_idx"], "item_idx")
    if by_file and not is_small(numbered):
        numbered = numbered.hint("rebalance", F.col("file_idx"))
    return tokenize(numbered, tokenizer, eod=eod).select(
        "file_idx",
        "item_idx",
        F.col("item_idx").alias("doc_idx"),
        F.col("n_tokens").cast("int").alias("size"),
        "tokens",
    )
