"""Registered queries, the pipeline, and the plan of the native operator."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from textmill.llm.graph import components
from textmill.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert rows == sorted(map(repr, expected))


def test_native_plan_has_no_python(spark, sf):
    plan = QUERIES["op1_quality_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


def test_pipeline(spark, sf, tmp_path, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        step(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.schema.simpleString() == docs.schema.simpleString()
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= before and len(kept) > 0.3 * len(before)
        docs, before = after, kept
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_on_edges(spark, sf, edges_null_id, tmp_path):
    """Extra columns, nulls, repeated rows and an empty table go through every stage."""
    for label, docs in (("edges", edges_null_id), ("none", edges_null_id.where("false"))):
        for name, step in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{label}-{name}")
            step(spark, docs, sf).write.parquet(out)
            docs = spark.read.parquet(out)
        assert docs.columns[:2] == ["doc_id", "piece"]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 100)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 140), 200]}}
    assert components(df.where("false")).count() == 0
