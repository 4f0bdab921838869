"""Merge the sub-datasets of a root into one dataset.

Packed samples are renumbered by shard and sequence number, text samples by file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.jobs.common import parser, session
from textmill.operators.merge import boundaries, merge_indexed, merge_samples
from textmill.operators.position import with_scan_position
from textmill.sinks.write import in_order, write_corpus
from textmill.sources.packed import read_parts
from textmill.staging import drop_staged

# Without --n-files: one output file for so many bytes of the input's size estimate.
FILE_BYTES = 512 << 20


def wanted_files(df: DataFrame, n_files: int | None) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n_files or max(1, -(-size // FILE_BYTES))


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    p.add_argument("--root", required=True, help="written samples by shard, or indexed datasets by output")
    p.add_argument("--out", required=True)
    p.add_argument("--indexed", action="store_true", help="the root holds indexed datasets")
    p.add_argument("--n-files", type=int, help="files of the merged dataset, in its order (default: by size)")
    p.add_argument("--codec")
    a = p.parse_args(argv)
    spark = session("merge")
    try:
        if a.indexed:
            merge_index(spark, a)
        else:
            df = spark.read.parquet(a.root)
            merged = merge_samples(df) if "seq" in df.columns else with_scan_position(df, "sample")
            merged = in_order(merged, "sample", df.count(), wanted_files(df, a.n_files))
            write_corpus(merged, a.out, codec=a.codec, mode="errorifexists")
    finally:
        drop_staged(spark)


def merge_index(spark, a) -> None:
    """One ordered dataset: items in files by their new index, and the document index from 0.

    Every part must have been finished, and all must have the same columns and types.
    """
    items, counts = read_parts(spark, a.root)
    merged = merge_indexed(items, "output", counts=counts)
    total = counts.agg(F.sum("n_items")).first()[0] or 0
    ordered = in_order(merged, "merged_idx", total, wanted_files(items, a.n_files))
    write_corpus(ordered, f"{a.out}/items", codec=a.codec, mode="errorifexists")
    ends = boundaries(merged, "output").repartitionByRange("end_idx").sortWithinPartitions("end_idx")
    write_corpus(ends, f"{a.out}/documents", codec=a.codec, mode="errorifexists")


if __name__ == "__main__":
    main()
