"""Identities, positions and shuffles under skew and under any input layout."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textmill.operators import position
from textmill.operators.copies import emit_copies
from textmill.operators.identity import number_copies, with_row_id, with_scan_id
from textmill.operators.shuffle import shuffle, shuffle_epochs
from textmill.operators.sharding import assign_shard
from textmill.sources.corpus import first_n


def test_shuffle_does_not_depend_on_the_layout(spark):
    df = spark.range(300).withColumn("text", F.concat(F.lit("t"), "id"))
    orders = []
    for parts, files in ((1, 3), (7, 5), (4, 1)):
        got = shuffle(df.repartition(parts), files, 9, "id", emit_pos=True).orderBy("shuffle_pos").collect()
        assert [r.shuffle_pos for r in got] == list(range(300))
        orders.append([r.id for r in got])
    assert orders[0] == orders[1] == orders[2]
    expected = sorted(range(300), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    assert orders[0] == expected


def test_shuffle_without_a_key_keeps_equal_rows(spark):
    df = spark.createDataFrame([("same", 1)] * 40 + [("other", None)] * 3, "text string, n int")
    got = shuffle(df, 4, emit_pos=True).collect()
    assert sorted(r.shuffle_pos for r in got) == list(range(43))
    assert sum(r.text == "same" for r in got) == 40


def test_layout_dependent_shuffle(spark):
    got = shuffle(spark.range(100), 3, seed=5, stable=False)
    assert sorted(r.id for r in got.collect()) == list(range(100))
    assert got.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        shuffle(spark.range(3), 1, stable=False, emit_pos=True)


def test_small_inputs_shuffle(spark):
    assert shuffle(spark.range(0), 3, emit_pos=True).count() == 0
    assert shuffle(spark.range(1), 3, emit_pos=True).first().shuffle_pos == 0


def test_copies_of_a_hot_row(spark):
    n = 10_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    got = number_copies(df)
    hot = sorted(r.copy for r in got.where("v = -1").collect())
    assert hot == list(range(len(hot))) and len(hot) == -(-n // 3)
    assert got.count() == n
    assert with_row_id(df).select("row_id").distinct().count() == n


def test_many_copies_are_emitted_by_many_tasks(spark):
    df = spark.createDataFrame([("a", 10_000), ("b", 3), ("c", 65), ("d", 1)], "v string, n long")
    got = emit_copies(df, "n", ["v"])
    for value, n in (("a", 10_000), ("b", 3), ("c", 65), ("d", 1)):
        assert sorted(r.copy for r in got.where(F.col("v") == value).collect()) == list(range(n))
    tasks = got.where("v = 'a'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 5000
    assert "Exchange" not in emit_copies(df, "n", ["v"], most=60)._jdf.queryExecution().executedPlan().toString()


def test_counting_copies_runs_once(spark, sf):
    flag = F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.col("l_orderkey").cast("string"))
    got = number_copies(spark.read.parquet(f"{sf}/lineitem.parquet").select(flag.alias("v"), "l_returnflag"))
    assert got.count() == 6000
    got.collect()
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert text.count("ReusedExchange") == 1


def test_scan_ids_are_unique(spark, sf):
    df = with_scan_id(spark.read.parquet(f"{sf}/lineitem.parquet"))
    assert df.select("row_id").distinct().count() == df.count()


def test_scan_position_over_files(spark, tmp_path):
    for part in ("b", "a"):
        for i in range(3):
            rows = spark.range(i * 10, i * 10 + 4).select("id", F.lit(f"{part}{i}").alias("file"))
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/part={part}")
    df = spark.read.parquet(str(tmp_path))
    got = position.with_scan_position(df).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(24))
    seen = [r.file for r in got]
    assert all(seen[k] == seen[k - k % 4] for k in range(24)) and len(set(seen)) == 6
    one = position.with_scan_position(df.where("part = 'a'")).orderBy("pos").collect()
    assert [r.pos for r in one] == list(range(12))
    with pytest.raises(Exception, match="whole files"):
        position.with_scan_position(df.where("id % 2 = 0")).collect()


def test_position_with_a_hot_leading_value(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), "id"
    )
    got = position.with_position(df.repartition(6), ["source", "id"], n=8).orderBy("pos").collect()
    keys = [(r.source, r.id) for r in got]
    assert keys == sorted(keys) and [r.pos for r in got] == list(range(5000))


def test_running_total_over_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(position, "BLOCK_ROWS", 8)
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("g"),
        F.col("id").alias("pos"),
        (F.col("id") % 7).alias("n"),
    )
    got = position.with_running_total(df, "n", "pos", ["g"]).orderBy("pos").collect()
    totals = {}
    for r in got:
        assert r.start == totals.get(r.g, 0)
        totals[r.g] = totals.get(r.g, 0) + r.n
    whole = position.with_running_total(df, "n", "pos").orderBy("pos").collect()
    running = 0
    for r in whole:
        assert r.start == running
        running += r.n


def test_running_total_renumbers_uneven_orders(spark, monkeypatch):
    monkeypatch.setattr(position, "BLOCK_ROWS", 4)
    rows = [(i, 1) for i in range(2000)] + [(1 << 50, 1)]
    df = spark.createDataFrame(rows, "pos long, n long")
    blocked, _ = position.with_blocks(df, "n", "pos")
    assert "_dense" in blocked.columns
    assert blocked.groupBy("_block").count().agg(F.max("count")).first()[0] < 600
    got = position.with_running_total(df, "n", "pos").orderBy("pos").collect()
    assert [r.start for r in got] == list(range(2001))


def test_running_total_of_nothing(spark):
    df = spark.createDataFrame([], "pos long, n long")
    assert position.with_running_total(df, "n", "pos").count() == 0


def test_epoch_orders_differ_and_are_permutations(spark):
    got = shuffle_epochs(spark.range(50), 1, [0, 1, 2], ["id"]).collect()
    per = {e: [r.id for r in sorted((r for r in got if r.epoch == e), key=lambda r: r.pos)] for e in range(3)}
    assert all(sorted(ids) == list(range(50)) for ids in per.values())
    assert per[0] != per[1] != per[2]


def test_shards_are_even(spark):
    df = spark.range(23).withColumnRenamed("id", "pos")
    for how in ("stride", "chunks"):
        sizes = [r["count"] for r in assign_shard(df, 5, how).groupBy("shard").count().collect()]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 23
    with pytest.raises(ValueError):
        assign_shard(df, 0)


def test_scan_positions_refuse_parts_of_files(spark, tmp_path):
    spark.range(100).repartition(2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    files = df.inputFiles()
    assert sorted(r.pos for r in position.with_scan_position(df).collect()) == list(range(100))
    for part in (df.sample(0.5, seed=1), df.limit(30), df.where("id > 5"), spark.read.parquet(files[0], files[0])):
        with pytest.raises(Exception, match="whole files"):
            position.with_scan_position(part).collect()


def test_first_n_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "k int, v int")
    assert [first_n(df, n, ["k"]).count() for n in (0, 2, 3, 4, 5)] == [0, 2, 3, 4, 4]
    assert [r.v for r in first_n(df, 1, ["k", "v"]).collect()] == [1]


def test_negative_zero_is_kept(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (-0.0, "a"), (None, "a")], "x double, s string")
    rows = number_copies(df).collect()
    assert sorted((str(r.x), r.copy) for r in rows) == [("-0.0", 0), ("-0.0", 1), ("0.0", 0), ("None", 0)]


def test_many_striding_shards_have_full_blocks(spark):
    """With 128 groups that take turns, a block still holds its share of a group's rows."""
    df = spark.range(200_000).select(F.pmod("id", F.lit(128)).alias("shard"), F.col("id").alias("pos"), F.lit(500).alias("n"))
    blocked, table = position.with_blocks(df, "n", "pos", ["shard"])
    sizes = [r["count"] for r in blocked.groupBy("shard", "_block").count().collect()]
    crossing = 2048 / 500  # documents a sample that crosses an edge takes part in
    assert len(sizes) == table.count() and crossing * len(sizes) / 200_000 < 0.05
