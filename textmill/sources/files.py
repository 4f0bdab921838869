"""File listings through Hadoop's file systems, so local and remote paths work alike.

A listing is metadata and lives on the driver; the data behind it is read by Spark.  However many
files there are, their names cross the bridge to Python in one call.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.chunks import numbered_name
from textmill.session import small_table


def _path(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _all_paths(spark: SparkSession, statuses) -> list[str]:
    """The paths of an array of file statuses, by a setting that takes them all as one text."""
    if not statuses:
        return []
    jvm = spark.sparkContext._jvm
    held = jvm.org.apache.hadoop.mapred.JobConf(False)
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)
    jvm.org.apache.hadoop.mapred.FileInputFormat.setInputPaths(held, paths)
    joined = held.getRaw("mapreduce.input.fileinputformat.inputdir")
    return [re.sub(r"\\(.)", r"\1", p) for p in re.findall(r"(?:[^,\\]|\\.)+", joined)]


def expand_glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in name order; local paths without a scheme, as they were given."""
    at, fs = _path(spark, pattern)
    found = _all_paths(spark, fs.globStatus(at))
    return sorted(found if "://" in pattern else [re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?(?=/)", "", p) for p in found])


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """``(name, is_directory)`` of a directory's direct entries, in name order."""
    at, fs = _path(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as scans report it (but for its special characters)."""
    at, fs = _path(spark, path)
    return str(fs.makeQualified(at).toString())


def is_dir(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def size_of(spark: SparkSession, path: str) -> int:
    at, fs = _path(spark, path)
    return fs.getContentSummary(at).getLength()


def decoded_path(path: Column) -> Column:
    """A path as the file source reports it, with its special characters put back."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def scanned_files(df: DataFrame) -> list[tuple[str, int]]:
    """Path and length of every file that a plain scan reads, in the scan's order, by one call of the bridge."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "Filter", "Sample"):
        node = node.children().head()
    listed = str(node.relation().location().allFiles().mkString("\n"))
    return [(m[1], int(m[2])) for m in re.finditer(r"path=(.*?); isDirectory=false; length=(\d+)", listed)]


def resolve_inputs(
    spark: SparkSession,
    files: str | None = None,
    glob: str | None = None,
    shard: int | None = None,
    n_shards: int | None = None,
) -> list[str]:
    """Input files: the colon-separated list as given, then the sorted matches of the glob.

    Duplicates stay.  With ``shard`` and ``n_shards`` every ``n_shards``-th file is taken,
    from the ``shard``-th on; the two belong together.
    """
    if not files and not glob:
        raise ValueError("give a list of input files or a glob")
    if (shard is None) != (n_shards is None):
        raise ValueError("shard and n_shards belong together; give both or neither")
    paths = _split_list(files) if files else []
    if glob:
        paths += expand_glob(spark, glob)
    return paths if shard is None else paths[shard::n_shards]


def _split_list(files: str) -> list[str]:
    """Split at colons, but not inside ``scheme://``."""
    parts: list[str] = []
    for piece in files.split(":"):
        if parts and piece.startswith("//"):
            parts[-1] += ":" + piece
        else:
            parts.append(piece)
    return [p for p in parts if p]


def file_catalog(spark: SparkSession, paths: Sequence[str], base: str | None = None) -> DataFrame:
    """``(file_idx, path)`` of an ordered list, with an output name per file if ``base`` is given."""
    table = small_table(spark, list(enumerate(paths)), ["file_idx", "path"], [pa.int64(), pa.string()])
    if base is None:
        return table
    return table.withColumn("output", numbered_name(base, F.col("file_idx"), len(paths)))
