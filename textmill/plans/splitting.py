"""Train/validation splits, their audit, and lookups by foreign ids or positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.position import with_scan_position
from textmill.operators.split import SEED, audit_split, left_side, only, right_side, split, without
from textmill.plans.tables import NUMBERED, draw_sql, md5_key, table

RIGHT_PROB = 0.1
RIGHT_MAX = 50


def marked_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return split(docs.select("doc_id", *columns), "doc_id", RIGHT_PROB, RIGHT_MAX)


def split_train_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_documents(spark, sf_dir, "text")


def split_default_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return right_side(split(table(spark, sf_dir, "lineitem"), key))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = marked_documents(spark, sf_dir).join(labels, "doc_id", "left")
    return labelled.groupBy("is_right", "quality").agg(F.count("*").alias("n"))


def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = marked_documents(spark, sf_dir)
    whole = table(spark, sf_dir, "documents").select("doc_id")
    return audit_split(left_side(marked), right_side(marked), whole, ["doc_id"])


def documents_not_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def rows_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"))
    return only(with_scan_position(table(spark, sf_dir, "documents")), wanted, ["pos"])


QUERIES = {
    "split_train_valid": split_train_valid,
    "split_default_lines": split_default_lines,
    "split_counts": split_counts,
    "split_audit": split_audit,
    "documents_not_labelled": documents_not_labelled,
    "rows_by_index": rows_by_index,
}


_MARKED = f"""
    marked as (
        select *, cast({draw_sql(md5_key(SEED, 'doc_id'))} as double) / cast(4294967296 as double)
            < least(cast({RIGHT_MAX} as double) / (select count(*) from documents),
                cast({RIGHT_PROB} as double)) as is_right
        from documents)"""

_LINE_KEY = md5_key(SEED, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

ORACLES = {
    "split_train_valid": f"with {_MARKED} select doc_id, text, is_right from marked",
    "split_default_lines": f"""
        select * from lineitem
        where cast({draw_sql(_LINE_KEY)} as double) / cast(4294967296 as double)
            < least(cast(1000 as double) / (select count(*) from lineitem), cast(0.001 as double))""",
    "split_counts": f"""
        with {_MARKED}
        select is_right, quality, count(*) as n from marked left join labels using (doc_id) group by 1, 2""",
    "split_audit": f"""
        with {_MARKED},
        l as (select doc_id from marked where not is_right),
        r as (select doc_id from marked where is_right)
        select (select count(*) from l) as n_left, (select count(*) from r) as n_right,
            (select count(*) from documents) as n_whole,
            (select count(*) from l semi join r using (doc_id)) as n_in_both,
            (select count(*) from documents d anti join (from l union all from r) using (doc_id)) as n_missing,
            (select count(*) from (from l union all from r) anti join documents d using (doc_id)) as n_foreign,
            (select count(*) - count(distinct doc_id) from (from l union all from r)) as n_repeated,
            (select count(*) from (select doc_id, count(*) as c from (from l union all from r) group by 1) s
                full join (select doc_id, count(*) as c from documents group by 1) w using (doc_id)
                where s.c is distinct from w.c) as n_miscounted""",
    "documents_not_labelled": "select * from documents where doc_id not in (select doc_id from labels)",
    "rows_by_index": f"with {NUMBERED} select * from numbered where pos in (select doc_id from labels)",
}
