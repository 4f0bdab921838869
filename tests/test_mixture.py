from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill import config, presets
from textmill.config import EvalGroup
from textmill.operators import mixture as mx


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.001, 1.0), min_size=1, max_size=8),
    st.integers(0, 10**12),
)
def test_apportion_adds_up(weights, size):
    parts = config.apportion(config.normalised(weights), size)
    assert sum(parts.values()) == size
    for name, share in config.normalised(weights).items():
        assert abs(parts[name] - share * size) <= 1 + size * 1e-8


def test_plan_rules():
    with pytest.raises(ValueError, match="add up"):
        config.check_shares({"a": 0.5, "b": 0.4})
    with pytest.raises(ValueError, match="gsw"):
        config.plan_mixture({"en": 5}, {"en": 0.5, "gsw": 0.5}, 10)
    (only,) = config.plan_mixture({"en": 4}, {"en": 1.0}, 10)
    assert (only.needed, only.full_copies, only.remainder) == (10, 2, 2)
    assert config.epoch_size(10**13, 4096) == 2_441_406_250
    assert config.run_tokens(445_048, 1152, 4096) == 445_048 * 4_718_592
    with pytest.raises(ValueError):
        config.normalised({"a": 0.0})


@pytest.fixture(scope="module")
def streams(spark):
    # A hot stream with most rows, a small one, and one row alone.
    rows = [("hot", i) for i in range(3000)] + [("small", i) for i in range(37)] + [("one", 0)]
    return spark.createDataFrame(rows, "stream string, id long").repartition(5).persist()


def test_mix_takes_what_the_plan_says(spark, streams):
    plans = mx.mixture_plan(streams, {"hot": 0.4, "small": 0.55, "one": 0.05}, 1000)
    needed = {p.stream: p.needed for p in plans}
    got = mx.mix(streams, plans, 3, "id").collect()
    assert len(got) == 1000 and Counter(r.stream for r in got) == needed
    for p in plans:
        copies = Counter(r.id for r in got if r.stream == p.stream)
        assert set(copies.values()) <= {p.full_copies, p.full_copies + 1}
    assert len({(r.stream, r.id, r.copy) for r in got}) == 1000
    again = mx.mix(streams.repartition(2), plans, 3, "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = mx.mix(streams, plans, 4, "id").collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


def test_whole_copies_need_no_remainder(spark, streams):
    plans = [config.StreamPlan("one", 1, 3), config.StreamPlan("small", 37, 74)]
    got = mx.mix(streams, plans, 0, "id").collect()
    assert Counter(r.stream for r in got) == {"one": 3, "small": 74}


def test_a_small_stream_repeated_very_often(spark, streams):
    plans = [config.StreamPlan("one", 1, 5000), config.StreamPlan("small", 37, 40)]
    got = mx.mix(streams, plans, 0, "id").collect()
    assert sorted(r.copy for r in got if r.stream == "one") == list(range(5000))
    assert sum(r.stream == "small" for r in got) == 40


def test_blend(streams):
    plans = mx.blend_plan(streams, {"hot": 3.0, "small": 1.0}, 100)
    assert {p.stream: p.needed for p in plans} == {"hot": 75, "small": 25}


def test_cyclic_pass(spark):
    df = spark.range(7).withColumnRenamed("id", "pos")
    for needed in (0, 3, 7, 20):
        got = sorted((r.cycle_pos, r.pos) for r in mx.cyclic_pass(df, needed, 7).collect())
        assert got == [(i, i % 7) for i in range(needed)]


def test_repeats(streams):
    got = mx.repeat_streams(streams, {"small": 2, "one": 0}).collect()
    assert Counter((r.stream, r.copy) for r in got) == {("small", 0): 37, ("small", 1): 37}


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert Counter(r.batch for r in mx.batches(df, 4, True).collect()) == {0: 4, 1: 4}
    assert Counter(r.batch for r in mx.batches(df, 4, False).collect()) == {0: 4, 1: 4, 2: 2}


def test_shuffled_positions_are_dense(spark, streams):
    got = mx.shuffled_positions(streams, 1, ["stream", "id"], n=4)
    assert sorted(r.pos for r in got.collect()) == list(range(3038))


def test_groups(streams):
    groups = [EvalGroup("ALL", ("hot", "small", "one", "none")), EvalGroup("S", ("small",), 2), EvalGroup("N", ("none",))]
    rows = Counter(r.label for r in mx.eval_groups(streams, groups).collect())
    assert rows == {"ALL": 3038, "S": 74}
    sizes = mx.eval_group_sizes(streams.withColumn("n", F.lit(2)), groups, "n").collect()
    assert {r.label: (r.n_streams, r.n_samples, r.n_tokens) for r in sizes} == {
        "ALL": (3, 3038, 6076),
        "S": (1, 74, 148),
    }


def test_budget(streams):
    got = mx.token_budget(streams.withColumn("n", F.lit(10)), {"hot": 0.5, "none": 0.5}, 60_000, "n").collect()
    rows = {r.stream: r for r in got}
    assert (rows["hot"].n_tokens, rows["hot"].n_needed, rows["hot"].passes) == (30_000, 30_000, 1.0)
    assert rows["none"].n_tokens == 0 and rows["none"].passes is None


def test_preset(spark):
    config.check_shares(presets.TRAIN_SHARES)
    size = config.epoch_size(presets.EPOCH_TOKENS, 4096)
    parts = config.apportion(presets.TRAIN_SHARES, size)
    assert len(parts) == 17 and sum(parts.values()) == size == 2_441_406_250
    assert abs(parts["gsw"] - 4.926151316429887e-08 * size) <= 1
    groups = presets.eval_groups()
    assert len(groups) == 11 and len(groups[0].streams) == 16
    rows = spark.createDataFrame([(s, 1) for s in presets.TRAIN_SHARES], "stream string, n int")
    sizes = {r.label: r.n_streams for r in mx.eval_group_sizes(rows, groups, "n").collect()}
    assert sizes["ALL"] == 16 and sizes["NLD"] == 4 and sizes["FAO"] == 1
