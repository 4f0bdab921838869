"""Row identities: what a stable order, split or mixture is a function of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.copies import emit_copies
from textmill.staging import BROADCAST_ROWS, stage


def with_row_id(df: DataFrame, key: str | None = None, name: str = "row_id") -> DataFrame:
    """Add a row id.

    With ``key``: that column, which must be unique.  Without: the content's MD5 and an
    occurrence number among equal rows, which needs nothing but the rows themselves.  The MD5s are
    counted first, on their own; a row whose MD5 is the only one of its kind stays where it is, and only
    copies are brought together to be numbered (all rows, if more contents repeat than may be broadcast).
    """
    if key is not None:
        return df.withColumn(name, F.col(key))
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))

    def numbered(rows: DataFrame) -> DataFrame:
        return number_copies(rows, "_copy").select(*kept, F.concat_ws("-", content, F.col("_copy").cast("string")).alias(name))

    kept = [F.col(f"`{c}`") for c in df.columns]
    repeated = stage(df.groupBy(content.alias("_content")).agg(F.count("*").alias("_n")).where("_n > 1").select("_content"), "repeated")
    if repeated.count() > BROADCAST_ROWS:
        return numbered(df)
    repeated = F.broadcast(repeated)
    marked = df.select("*", content.alias("_content"))
    alone = marked.join(repeated, "_content", "left_anti").select(*kept, F.concat(F.col("_content"), F.lit("-0")).alias(name))
    copies = marked.join(repeated, "_content", "left_semi").select(*kept)
    return alone.unionByName(numbered(copies))


def number_copies(df: DataFrame, name: str = "copy") -> DataFrame:
    """Number equal rows 0, 1, 2, ...

    Equal rows cannot be told apart, so they are counted (summed before the shuffle, however
    many there are) and emitted again.
    """
    # Grouping makes -0.0 to 0.0; the two are told apart by their text, in one column of digits, and put back.
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    digit = {c: i + 1 for i, c in enumerate(real)}
    marks = [F.when(F.col(f"`{c}`").cast("string") == "-0.0", "1").otherwise("0") for c in real]
    marked = df.select("*", F.concat(*marks).alias("_negative_zeros")) if real else df
    counted = marked.groupBy(*[F.col(f"`{c}`") for c in marked.columns]).agg(F.count("*").alias("_n"))
    restored = counted.select(
        *[
            F.when(F.substring("_negative_zeros", digit[c], 1) == "1", F.lit(-0.0).cast(df.schema[c].dataType))
            .otherwise(F.col(f"`{c}`"))
            .alias(c)
            if c in digit
            else F.col(f"`{c}`")
            for c in df.columns
        ],
        "_n",
    )
    return emit_copies(restored, "_n", df.columns, name=name)


def with_scan_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row id of a Parquet scan: file path and row index, known without a shuffle."""
    return df.select(
        "*",
        F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias(name),
    )
