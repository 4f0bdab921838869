"""Tokeniser files, read through Spark so remote paths work.

They are sent to every task, so each is checked against ``max_bytes``; raise it for larger ones.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from textmill.sources.files import size_of

MAX_ASSET_BYTES = 256 << 20


def read_bytes(spark: SparkSession, path: str, max_bytes: int = MAX_ASSET_BYTES) -> bytes:
    size = size_of(spark, path)
    if size > max_bytes:
        raise ValueError(f"{path}: {size} bytes are more than max_bytes={max_bytes}")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_vocab(spark: SparkSession, path: str) -> dict[str, int]:
    """Vocabulary JSON: one object, token to id."""
    return json.loads(read_bytes(spark, path).decode("utf-8"))


def read_merges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Merges text: two symbols per line, best first; a version line is skipped."""
    lines = read_bytes(spark, path).decode("utf-8").splitlines()
    pairs = [line.split(" ") for line in lines if line and not line.startswith("#version")]
    return [(left, right) for left, right in pairs]
