"""Incremental tokenising: every new input file is taken up once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textmill.operators.tokenize import Tokenizer, tokenize


def read_new_files(
    spark: SparkSession,
    src: str,
    schema: T.StructType | str,
    fmt: str = "json",
    max_files: int | None = None,
) -> DataFrame:
    """Stream of the rows of files as they appear, with their file and a content id."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(src)
    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.select("*", F.col("_metadata.file_path").alias("file"), content.alias("content_id"))


def ingest(
    spark: SparkSession,
    src: str,
    out: str,
    checkpoint: str,
    tokenizer: Tokenizer,
    schema: T.StructType | str,
    fmt: str = "json",
    text_col: str = "text",
    eod: int | None = None,
    max_files: int | None = None,
    spread: int | None = None,
) -> StreamingQuery:
    """Tokenise all files that are new since the last run and append them to ``out``.

    The checkpoint knows the files that are done and the file sink commits whole batches, so a
    restart neither loses nor repeats a file.  Packing needs a running offset over all
    documents and stays a batch job on the table that grows here.  ``spread`` deals the rows of
    a few small files out to so many tasks.
    """
    docs = read_new_files(spark, src, schema, fmt, max_files)
    if spread is not None:
        docs = docs.repartition(spread)
    query = (
        tokenize(docs, tokenizer, text_col, eod=eod)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    return query
