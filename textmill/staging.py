"""Written intermediate tables.

Two passes over "the same partitions" (count, then number) are only safe when both
read the same bytes, also after an executor is lost.  So such intermediates are
written as Parquet below the shared folder named by ``spark.checkpoint.dir`` and read
back; later passes then also get column pruning.  No block of an executor's local
disk is ever needed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"

# Folders of the tables that this process has staged, in order.
_made: list[str] = []

# Rows of (name, few longs) that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 500_000


def staging_root(spark: SparkSession) -> str:
    """Folder for this application's staged tables."""
    sc = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textmill-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/textmill-{sc.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that scans the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_summary(df: DataFrame, label: str) -> DataFrame:
    """Stage a table that sums up the data (counts per file, per part, ...) to join it to the data.

    Its true size is known once it is written: a small one is marked for broadcast, so the
    data is not shuffled for it; a larger one is left to the optimiser.  Without this the
    optimiser would guess the size of an aggregate from that of its input.
    """
    table = stage(df, label)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def staged_so_far() -> int:
    """Number of tables staged by this process; marks a place for :func:`staged_since`."""
    return len(_made)


def staged_since(mark: int) -> list[str]:
    """Folders of the tables staged after ``mark``."""
    return _made[mark:]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession, folders: list[str]) -> None:
    """Delete some staged tables, once no frame reads them any more."""
    for folder in folders:
        if folder.startswith(staging_root(spark)):
            _delete(spark, folder)


def drop_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application, once no frame reads them any more."""
    _delete(spark, staging_root(spark))
