"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(ids, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """Up to ``n`` labelled documents as ``(doc_id, text, y, fold)``, chosen by a hash of the id.

    ``labels`` holds the rows that may be learnt from.  Null labels and ids are left out; if a
    document is labelled twice, the larger label counts.  ``n`` bounds what is broadcast and learnt.
    ``fold`` is 0 to 2.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(n)
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int")
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", fold.alias("fold"))
