"""Session settings for local runs (tests, bench).  On a cluster use spark-submit."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES_PER_CORE = 32 << 20

# The same for pieces of documents, whose ids are gathered again: ten times their compressed texts, in memory.
PIECES_BYTES_PER_CORE = 4 << 20

# Settings that the jobs need.  The vectorised Parquet reader holds whole batches of rows: with
# token arrays of long documents its default of 4096 rows can fill a heap.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def local_session(cpus: int | str = "*", app: str = "textmill", **conf: str) -> SparkSession:
    """A local session; ``conf`` entries use ``__`` for the dots of a setting name."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    settings = SETTINGS | {name.replace("__", "."): value for name, value in conf.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_width(df: DataFrame) -> int:
    """Default partition count for an explicit repartitioning: the session's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, per_core: int = SMALL_BYTES_PER_CORE) -> bool:
    """Whether the plan's size estimate leaves a core less than ``per_core`` bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * per_core


def spread_if_small(df: DataFrame, per_core: int = SMALL_BYTES_PER_CORE) -> DataFrame:
    """Spread a small input over all cores before costly work per row.

    A few megabytes often lie in one Parquet row group, hence in one task.  A large input has
    tasks enough and stays where it is.
    """
    if df.isStreaming or not is_small(df, per_core):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def small_table(
    spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str], types: Sequence[pa.DataType]
) -> DataFrame:
    """A configuration table whose size the optimiser knows (a local relation)."""
    columns = list(zip(*rows)) if rows else [() for _ in names]
    arrays = [pa.array(list(values), type=t) for values, t in zip(columns, types)]
    return spark.createDataFrame(pa.table(dict(zip(names, arrays))))
