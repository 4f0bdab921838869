"""From raw documents to packed training bins, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept; its
result is written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  Nulls count as empty texts, repeated rows are handled like others, an
empty table passes through as one, and further columns are carried along.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import best_fit, ngram_join, quality_rules, repeats, toxicity
from textmill.staging import drop_tables, stage, stage_summary, staged_since, staged_so_far

_held: list[str] = []  # tables that the stage called last works with


def _releasing(step: Callable) -> Callable:
    """A stage that first drops the tables of the one before, whose result is written by then."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _held)
        mark = staged_so_far()
        try:
            return step(spark, docs, sf_dir)
        finally:
            _held[:] = staged_since(mark)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one row an id); null ids match each other.

    The ids are written and counted; few are broadcast, so that no text is moved.
    """
    dropped = stage_summary(ids.select(F.col("doc_id").alias("_dropped_id")), "dropped")
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("_dropped_id")), "left_anti")


@_releasing
def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host is rejected.

    Rows that share an id stay if any of them stays.
    """
    verdicts = quality_rules.rule_verdicts(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return _without(docs, verdicts.where("not kept"))


@_releasing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more for toxicity; learns from all labels of kept documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


@_releasing
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    found = ngram_join.ngram_components(docs)
    return _without(docs, found.where("doc_id <> component_id").select("doc_id").distinct())


@_releasing
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of 200 bytes and more out of the texts; ``n_chars`` is counted anew."""
    left = repeats.without_repeats(docs)
    return left.select(
        *[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


@_releasing
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: one row per piece of a document, with its bin and its place there."""
    return best_fit.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_array_dedup", without_repeated_passages),
    ("best_fit_packing", packed),
]

# Trained models, graph components and packing have no SQL form; see tests/llm for the checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
