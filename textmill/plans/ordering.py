"""Random orders, positions and first-n samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.identity import number_copies
from textmill.operators.position import with_position, with_running_total, with_scan_position
from textmill.operators.shuffle import shuffle
from textmill.plans.tables import md5_key, table
from textmill.session import shuffle_width
from textmill.sources.corpus import first_n

SEED = 7
FIRST = 100
MANY = 4000


def shuffle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shuffle(docs, shuffle_width(docs), SEED, "doc_id", emit_pos=True)


def shuffle_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return shuffle(orders, shuffle_width(orders), SEED, "o_orderkey", emit_pos=True)


def shuffle_lineitem_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the line items, so that every row is there again."""
    once = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    lines = number_copies(once.unionByName(once)).select(*once.columns, cents, "copy")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "copy"]
    return shuffle(lines, shuffle_width(lines), SEED, key, emit_pos=True)


def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scan_position(table(spark, sf_dir, "documents")).select("doc_id", "pos")


def positions_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"])


def first_n_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n(table(spark, sf_dir, "documents"), FIRST, ["doc_id"])


def first_n_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return first_n(lines, 10 * FIRST, order).drop("l_shipdate")


def first_n_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows than a top-n is used for."""
    order = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return first_n(table(spark, sf_dir, "lineitem"), MANY, order)


def first_n_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a column that is null for most rows; nulls come first."""
    rated = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return first_n(rated.select("doc_id", "quality", "text"), 7 * FIRST, ["quality", "doc_id"])


def unsharded_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_tokens"))
    return with_running_total(sizes, "n_tokens", "doc_id")


QUERIES = {
    "shuffle_documents": shuffle_documents,
    "shuffle_orders": shuffle_orders,
    "shuffle_lineitem_copies": shuffle_lineitem_copies,
    "stream_positions": stream_positions,
    "positions_by_source": positions_by_source,
    "first_n_documents": first_n_documents,
    "first_n_lines": first_n_lines,
    "first_n_many": first_n_many,
    "first_n_nullable": first_n_nullable,
    "unsharded_token_offsets": unsharded_token_offsets,
}

ORACLES = {
    "shuffle_documents": f"""
        select *, row_number() over (order by {md5_key(SEED, 'doc_id')}, doc_id) - 1 as shuffle_pos
        from documents""",
    "shuffle_orders": f"""
        select *, row_number() over (order by {md5_key(SEED, 'o_orderkey')}, o_orderkey) - 1 as shuffle_pos
        from orders""",
    "shuffle_lineitem_copies": f"""
        with twice as (
            select *, cast(round(l_extendedprice * 100) as bigint) as cents
            from (from lineitem union all from lineitem)),
        copies as (
            select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) - 1 as copy
            from twice)
        select *, row_number() over (
            order by {md5_key(SEED, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'cents', 'copy')},
                l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, copy) - 1 as shuffle_pos
        from copies""",
    "stream_positions": "select doc_id, row_number() over (order by doc_id) - 1 as pos from documents",
    "positions_by_source": """
        select source, doc_id, row_number() over (order by source, doc_id) - 1 as pos from documents""",
    "first_n_documents": f"select * from documents order by doc_id limit {FIRST}",
    "first_n_lines": f"""
        select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem
        order by l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber limit {10 * FIRST}""",
    "first_n_many": f"""
        select * from lineitem
        order by l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber limit {MANY}""",
    "first_n_nullable": f"""
        select doc_id, quality, text from documents left join labels using (doc_id)
        order by quality nulls first, doc_id limit {7 * FIRST}""",
    "unsharded_token_offsets": """
        select doc_id, octet_length(encode(text)) as n_tokens,
            cast(coalesce(sum(octet_length(encode(text))) over (
                order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start
        from documents""",
}
