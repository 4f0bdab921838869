import numpy as np
from pyspark.sql import functions as F

from textmill.functions.chunks import ceil_block, even_chunk, int_div, numbered_name, stride_shard


def _indices(spark, sizes, shards):
    rows = [(n, w, i) for n in sizes for w in shards for i in range(n)]
    return spark.createDataFrame(rows, "n long, w int, i long")


def test_even_chunk_is_array_split(spark):
    for w in (1, 2, 5, 11):
        df = _indices(spark, range(0, 40), [w])
        got = {(r.n, r.i): r.s for r in df.select("n", "i", even_chunk(F.col("i"), F.col("n"), w).alias("s")).collect()}
        for n in range(0, 40):
            expected = [s for s, part in enumerate(np.array_split(np.arange(n), w)) for _ in part]
            assert [got[n, i] for i in range(n)] == expected


def test_ceil_blocks_and_strides(spark):
    for n, w in [(7, 3), (6, 4), (1, 5), (10, 10), (9, 4)]:
        df = spark.range(n).select(
            "id", ceil_block(F.col("id"), n, w).alias("b"), stride_shard(F.col("id"), w).alias("s")
        )
        size = -(-n // w)
        for r in df.collect():
            assert r.b == r.id // size and r.s == r.id % w


def test_int_div_is_exact_beyond_doubles(spark):
    big = (1 << 60) + 1
    assert spark.range(1).select(int_div(F.lit(big), 3)).first()[0] == big // 3


def test_names_are_padded_to_the_total(spark):
    names = spark.range(12).select(numbered_name("c4", F.col("id"), 12).alias("n"))
    assert [r.n for r in names.orderBy("id").collect()][:2] == ["c4_00", "c4_01"]
