"""Incremental ingest, run to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import fingerprint
from textmill.operators.tokenize import word_hash_tokenizer
from textmill.plans.tokens import _WORD_IDS, EOS
from textmill.staging import staging_root
from textmill.streaming.ingest import ingest


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{staging_root(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    query = ingest(
        spark,
        f"{sf_dir}/documents*.parquet",
        f"{root}/out",
        f"{root}/checkpoint",
        word_hash_tokenizer(),
        schema,
        fmt="parquet",
        eod=EOS,
        spread=spark.sparkContext.defaultParallelism,
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        "doc_id", "n_tokens", fingerprint(F.col("tokens")).alias("fingerprint")
    )


QUERIES = {"ingest_documents": ingest_documents}

ORACLES = {
    "ingest_documents": f"""
        with docs as (
            select doc_id, list_concat({_WORD_IDS}, [cast({EOS} as bigint)]) as ids from documents)
        select doc_id, cast(len(ids) as bigint) as n_tokens,
            md5(array_to_string(ids, ',')) as fingerprint
        from docs""",
}
