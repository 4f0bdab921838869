"""Arguments that several jobs share."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from textmill.operators.tokenize import (
    Tokenizer,
    byte_level_tokenizer,
    byte_tokenizer,
    word_hash_tokenizer,
)
from textmill.session import SETTINGS
from textmill.sources.assets import read_merges, read_vocab


def session(name: str) -> SparkSession:
    builder = SparkSession.builder.appName(f"textmill-{name}")
    for setting, value in SETTINGS.items():
        builder = builder.config(setting, value)
    return builder.getOrCreate()


def parser(description: str) -> argparse.ArgumentParser:
    return argparse.ArgumentParser(description=description)


def add_inputs(p: argparse.ArgumentParser) -> None:
    p.add_argument("--files", help="colon-separated list of input files")
    p.add_argument("--glob", help="glob of input files; its matches follow the list in name order")
    p.add_argument("--shard", type=int, help="take every n-th file from this one on")
    p.add_argument("--n-shards", type=int)
    p.add_argument("--input-format", choices=["parquet", "json"], default="parquet")


def add_tokenizer(p: argparse.ArgumentParser, default: str | None = "bytes") -> None:
    p.add_argument(
        "--tokenizer",
        default=default,
        help="bytes, words or bpe:<vocab.json>,<merges.txt>",
    )


def make_tokenizer(spark: SparkSession, spec: str | None) -> Tokenizer:
    if not spec:
        raise ValueError("token ids need a --tokenizer")
    kind, _, rest = spec.partition(":")
    if kind == "bytes":
        return byte_tokenizer()
    if kind == "words":
        return word_hash_tokenizer()
    if kind == "bpe":
        vocab, merges = rest.split(",")
        return byte_level_tokenizer(spark, read_vocab(spark, vocab), read_merges(spark, merges))
    raise ValueError(f"unknown tokeniser {spec}")
