"""Access to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.sources.corpus import read_corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/{name}.parquet")


# The documents in stream order, as both engines number them.
NUMBERED = "numbered as (select *, row_number() over (order by doc_id) - 1 as pos from documents)"


def md5_key(seed: int, *columns: str) -> str:
    """SQL of a stable key."""
    parts = ", ".join(f"cast({c} as varchar)" for c in columns)
    return f"md5(concat_ws(':', '{seed}', {parts}))"


def draw_sql(key: str) -> str:
    """SQL of a key's first 32 bits."""
    return f"cast('0x' || substr({key}, 1, 8) as bigint)"
