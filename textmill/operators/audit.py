"""Checks and reports on token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: embedding tables are padded to a multiple of this.
VOCAB_MULTIPLE = 128


def padded_vocab(vocab_size: int, multiple: int = VOCAB_MULTIPLE) -> int:
    return -(-vocab_size // multiple) * multiple


def token_report(df: DataFrame, by: str, tokens_col: str = "tokens") -> DataFrame:
    """Rows and tokens per group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.size(tokens_col)).cast("long").alias("n_tokens"),
        F.max(F.size(tokens_col)).cast("long").alias("longest"),
    )


def token_range_audit(
    df: DataFrame, vocab_size: int, multiple: int = VOCAB_MULTIPLE, tokens_col: str = "tokens"
) -> DataFrame:
    """One row: lowest and highest id, and whether they fit the padded vocabulary."""
    padded = padded_vocab(vocab_size, multiple)
    found = df.agg(
        F.min(F.array_min(tokens_col)).alias("min_id"), F.max(F.array_max(tokens_col)).alias("max_id")
    )
    fits = (F.col("min_id") >= 0) & (F.col("max_id") < padded)
    return found.select("min_id", "max_id", F.lit(padded).cast("long").alias("padded_vocab"), fits.alias("fits"))


def text_audit(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents without a text (left out by tokenising) and with an empty one."""
    return df.agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col(text_col).isNull()).alias("n_null"),
        F.count_if(F.col(text_col) == "").alias("n_empty"),
    )
