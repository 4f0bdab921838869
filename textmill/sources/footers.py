"""What Parquet files say of themselves: rows and columns, read from their footers by tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources.lines import open_file

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES_PER_TASK = 64


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, columns = [], []
        for path in batch.column("path").to_pylist():
            with open_file(path) as f:
                footer = pq.ParquetFile(f)
                rows.append(footer.metadata.num_rows)
                columns.append(", ".join(sorted(f"{x.name}: {x.type}" for x in footer.schema_arrow)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), pa.array(rows, pa.int64()), pa.array(columns, pa.string())],
            names=["path", "n_rows", "columns"],
        )


def read_footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, n_rows, columns)`` of Parquet files; ``columns`` are names and types, by name."""
    listed = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())}))
    tasks = max(1, len(paths) // FILES_PER_TASK)
    return listed.repartition(tasks).mapInArrow(_read, "path string, n_rows long, columns string")


def part_of(path: Column) -> Column:
    """Name of the folder a file lies in, without the ``column=`` of a partition folder."""
    return F.regexp_extract(path, r"/(?:[^/=]+=)?([^/]*)/[^/]+$", 1)
