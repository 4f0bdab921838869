import pytest
from pyspark.sql import functions as F

from textmill.operators import merge
from textmill.operators.merge import merge_indexed
from textmill.operators.split import audit_split, left_side, only, right_probability, right_side, split, without
from textmill.sources import packed


def test_probability():
    assert right_probability(10, 0.5, 1000) == 0.5
    assert right_probability(10_000, 0.5, 1000) == 0.1
    assert right_probability(0) == 0.0


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(4000)
    marked = split(df, "id", right_prob=0.1)
    again = split(df.repartition(5), "id", right_prob=0.1)
    left, right = left_side(marked), right_side(marked)
    audit = audit_split(left, right, df, ["id"]).first()
    assert audit.n_left + audit.n_right == audit.n_whole == 4000
    assert (audit.n_in_both, audit.n_missing, audit.n_foreign, audit.n_repeated) == (0, 0, 0, 0)
    assert 300 < audit.n_right < 500
    assert {r.id for r in right.collect()} == {r.id for r in right_side(again).collect()}
    other = right_side(split(df, "id", right_prob=0.1, seed=1))
    assert {r.id for r in right.collect()} != {r.id for r in other.collect()}


def test_empty_split(spark):
    marked = split(spark.range(0), "id")
    assert left_side(marked).count() == right_side(marked).count() == 0


def test_audit_counts_faults(spark):
    whole = spark.range(6)
    left = spark.createDataFrame([(0,), (1,), (1,), (2,), (9,)], "id long")
    right = spark.createDataFrame([(2,), (3,)], "id long")
    audit = audit_split(left, right, whole, ["id"]).first()
    assert (audit.n_in_both, audit.n_missing, audit.n_foreign, audit.n_repeated) == (1, 2, 1, 1)
    nothing = audit_split(whole.limit(0), whole.limit(0), whole.limit(0), ["id"]).first()
    assert nothing.n_whole == 0 and nothing.n_missing == 0


def test_lookups(spark):
    ids = spark.createDataFrame([(1,), (1,), (7,)], "id long")
    assert sorted(r.id for r in only(spark.range(5), ids, ["id"]).collect()) == [1]
    assert without(spark.range(5), ids, ["id"]).count() == 4


def packed_part(spark, shard, n, kind="int"):
    rows = [(shard, s, 2, [shard, s]) for s in range(n)]
    return spark.createDataFrame(rows, f"shard long, seq long, n_tokens int, tokens array<{kind}>")


def test_merge_of_parts_renumbers_all(spark):
    parts = [packed_part(spark, 2, 2), packed_part(spark, 0, 4), packed_part(spark, 1, 0)]
    got = merge.merge_samples(merge.append_parts(parts)).orderBy("sample").collect()
    assert [(r.sample, r.shard, r.seq) for r in got] == [
        (i, s, q) for i, (s, q) in enumerate([(0, 0), (0, 1), (0, 2), (0, 3), (2, 0), (2, 1)])
    ]


def test_parts_must_agree(spark):
    with pytest.raises(ValueError, match="nothing to merge"):
        merge.append_parts([])
    with pytest.raises(ValueError, match="differ in type"):
        merge.append_parts([packed_part(spark, 0, 1), packed_part(spark, 1, 1, "bigint")])


def test_indexed_merge(spark):
    # Dataset a: documents of 2 and 1 items; dataset b: one document of 3 items.
    rows = [("b", 0, 0), ("b", 1, 0), ("b", 2, 0), ("a", 0, 0), ("a", 1, 0), ("a", 2, 1)]
    items = spark.createDataFrame(rows, "dataset string, item_idx long, doc_idx long")
    merged = merge.merge_indexed([items.where("dataset = 'b'"), items.where("dataset = 'a'")])
    assert [(r.dataset, r.item_idx) for r in merged.orderBy("merged_idx").collect()] == [
        (d, i) for d in "ab" for i in range(3)
    ]
    bounds = [r.end_idx for r in merge.document_bounds(merged).orderBy("end_idx").collect()]
    assert [0, *bounds] == [0, 2, 3, 6]


def test_offsets_of_many_parts(spark):
    df = spark.range(500).select(F.format_string("p%03d", F.col("id") % 40).alias("part"))
    rows = merge.part_offsets(df, "part").orderBy("part").collect()
    running = 0
    for r in rows:
        assert r.item_offset == running
        running += r.n_items
    assert running == 500


def test_a_root_of_many_parts_is_one_scan(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = spark.range(3000).select(
        F.format_string("part %04d", F.col("id") % 1000).alias("output"),
        F.floor(F.col("id") / 1000).alias("item_idx"),
        F.floor(F.col("id") / 1000).alias("doc_idx"),
        F.lit(1).alias("size"),
        F.array(F.col("id").cast("int")).alias("tokens"),
    )
    rows.repartition(4, "output").write.partitionBy("output").parquet(root)
    items, counts = packed.read_parts(spark, root)
    assert items._jdf.queryExecution().analyzed().toString().count("parquet") == 1
    merged = merge_indexed(items, "output", counts=counts)
    got = {r["merged_idx"]: (r["output"], r["item_idx"]) for r in merged.collect()}
    assert got == {3 * p + i: (f"part {p:04d}", i) for p in range(1000) for i in range(3)}
    assert "Exchange hash" not in merged._jdf.queryExecution().executedPlan().toString()


def test_parts_of_other_types_or_columns_are_refused(spark, tmp_path):
    for k, (first, second) in enumerate([("id", "cast(id as int) as id"), ("id", "id as other"), ("id", "id, 1 as more")]):
        root = str(tmp_path / str(k))
        for part, columns in (("a", first), ("b", second)):
            spark.range(3).selectExpr(*columns.split(", ")).write.parquet(f"{root}/{part}")
        with pytest.raises(ValueError, match="differ in type"):
            packed.read_parts(spark, root)
    same = str(tmp_path / "same")
    for part in ("b", "a"):
        spark.range(2).withColumn("item_idx", F.col("id")).write.parquet(f"{same}/{part}")
    items, counts = packed.read_parts(spark, same)
    merged = merge_indexed(items, "output", counts=counts).collect()
    assert sorted((r["output"], r["id"], r["merged_idx"]) for r in merged) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 1, 3)]
