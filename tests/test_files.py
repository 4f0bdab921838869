"""Sources: lists, globs, directories, JSON lines, gzip, catalogues, completeness."""

import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textmill.operators import position
from textmill.operators.indexed import indexed_datasets, read_files_in_order
from textmill.operators.position import with_line_position
from textmill.operators.tokenize import byte_tokenizer
from textmill.sources import corpus, files, packed, streams
from textmill.sources.assets import read_merges, read_vocab
from textmill.sources.lines import lines_of_range
from textmill.staging import staged_since, staged_so_far


def write_lines(path, texts):
    with open(path, "w", encoding="utf-8") as f:
        for t in texts:
            f.write(json.dumps({"text": t}) + "\n")
    return str(path)


@pytest.fixture
def seven(tmp_path):
    return [write_lines(tmp_path / f"part{i}.jsonl", [f"{i}-{j}" for j in range(3)]) for i in range(7)]


def test_list_then_sorted_glob_with_duplicates(spark, tmp_path, seven):
    listed = f"{seven[5]}:{seven[0]}:{seven[0]}"
    got = files.resolve_inputs(spark, listed, str(tmp_path / "*.jsonl"))
    assert got == [seven[5], seven[0], seven[0], *seven]
    df = corpus.read_corpus(spark, got, "json", "text string")
    assert df.count() == 30
    assert df.where("text = '0-1'").count() == 3


def test_file_sharding(spark, tmp_path, seven):
    glob = str(tmp_path / "*.jsonl")
    shards = [files.resolve_inputs(spark, glob=glob, shard=k, n_shards=3) for k in range(3)]
    assert shards[1] == seven[1::3]
    assert sorted(sum(shards, [])) == seven


def test_input_rules(spark, seven):
    with pytest.raises(ValueError):
        files.resolve_inputs(spark)
    with pytest.raises(ValueError):
        files.resolve_inputs(spark, seven[0], shard=1)
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, [])


def test_remote_names_survive_the_colon_list(spark):
    assert files.resolve_inputs(spark, "hdfs://a/x:s3a://b/y:/z") == ["hdfs://a/x", "s3a://b/y", "/z"]


def test_directories(spark, tmp_path):
    df = spark.range(4).withColumn("text", F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    df.coalesce(1).write.parquet(str(tmp_path / "a" / "b"))
    (tmp_path / "a" / "_note").write_text("not data")
    root = str(tmp_path / "a")
    assert corpus.read_corpus(spark, corpus.direct_files(spark, root)).count() == 4
    assert corpus.read_corpus(spark, root, recurse=True).count() == 8
    single = corpus.direct_files(spark, root)[0]
    assert corpus.direct_files(spark, single) == [single]


def test_comma_list_and_subset(spark, tmp_path):
    df = spark.range(6).withColumn("subset", F.when(F.col("id") < 2, "en").otherwise("de"))
    df.write.partitionBy("subset").parquet(str(tmp_path / "c"))
    assert corpus.read_corpus(spark, str(tmp_path / "c"), subset="en").count() == 2
    write_lines(tmp_path / "x.jsonl", ["1"])
    write_lines(tmp_path / "y.jsonl", ["2", "3"])
    got = corpus.read_list(spark, "x.jsonl, y.jsonl", "json", str(tmp_path), "text string")
    assert got.count() == 3


def test_gzip_ingest_and_first_n(spark, tmp_path):
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        for i in range(25):
            f.write(json.dumps({"id": i, "text": f"t{i}"}) + "\n")
    out = corpus.decompress_json(spark, str(tmp_path / "d.json.gz"), str(tmp_path / "plain"), "id long, text string")
    assert out.count() == 25
    assert not [n for n in os.listdir(tmp_path / "plain") if n.endswith(".gz")]
    assert sorted(r.id for r in corpus.first_n(out, 10, ["id"]).collect()) == list(range(10))
    assert corpus.first_n(out, 0, ["id"]).count() == 0
    assert corpus.first_n(out, 99, ["id"]).count() == 25
    assert corpus.first_n(out.where("id < 0"), 5, ["id"]).count() == 0


@pytest.mark.parametrize("top", [0, 1000])
def test_first_n_by_several_columns(spark, monkeypatch, top):
    monkeypatch.setattr(corpus, "TOP_N_KEYS", top)
    df = spark.range(50).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    got = sorted((r.a, r.b) for r in corpus.first_n(df, 20, ["a", "b"]).collect())
    assert got == sorted((i % 3, i) for i in range(50))[:20]
    assert corpus.first_n(df, 51, ["a", "b"]).count() == 50


def test_line_positions_follow_files_and_splits(spark, seven):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        df = with_line_position(corpus.read_corpus(spark, seven, "json", "text string"))
        got = [r.text for r in df.orderBy("pos").collect()]
        positions = sorted(r.pos for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i}-{j}" for i in range(7) for j in range(3)]
    assert positions == list(range(21))


@pytest.fixture
def odd_lines(spark, tmp_path):
    """JSON lines with blank, broken and very long lines, other line ends, no last line end, and a packed file."""
    rng = random.Random(1)
    for i, (name, end) in enumerate([("a.jsonl", b"\n"), ("b c%20.jsonl", b"\r\n"), ("d.jsonl.gz", b"\n"), ("e.jsonl", b"\n")]):
        lines = []
        for j in range(100):
            text = f"{name} {j} " + "é漢x" * rng.choice([0, 3, 30, 400])
            lines.append(json.dumps({"text": text, "n": j}, ensure_ascii=False).encode())
            if j % 9 == 0:
                lines.append(rng.choice([b"", b"  ", b"\t"]))
        lines += [b"{broken"] if i == 3 else []
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wb") as f:
            f.write(end.join(lines) + (b"" if i % 2 else end))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    return corpus.read_corpus(spark, str(tmp_path), "json", "text string, n long")


def test_first_n_numbers_few_keys(spark, monkeypatch):
    """Also where keys are null or one of them makes up a third of all rows."""
    monkeypatch.setattr(corpus, "SAMPLE_KEYS", 2000)
    wide = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.col("id").alias("v"))
    for n in (1001, 5000, 60_000, 99_999):
        mark = staged_so_far()
        got = corpus.first_n(wide, n, ["k"])
        kept = [spark.read.parquet(p).count() for p in staged_since(mark)]
        assert len(kept) == 1 and kept[0] < 2 * n
        want = sorted(i * 7919 % 100_003 for i in range(100_000))[:n]
        assert sorted(r.k for r in got.collect()) == want
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id"))
    mixed = spark.range(30_000).select(hot.alias("a"), F.col("id").alias("b"))
    rows = sorted(map(tuple, mixed.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (1500, 9000, 29_000):
        got = corpus.first_n(mixed, n, ["a", "b"]).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == rows[:n]
    nulls = spark.range(9000).select(F.when(F.col("id") > 4000, F.col("id")).alias("a"))
    assert corpus.first_n(nulls, 3000, ["a"]).where("a is not null").isEmpty()


@pytest.mark.parametrize("size", [9973, 1 << 20])
def test_line_positions_do_not_depend_on_ranges(odd_lines, size):
    written = position._with_written_line_position(odd_lines, "pos")
    got = position.with_line_position(odd_lines, range_bytes=size)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == sorted(map(tuple, written.collect()), key=lambda r: r[-1])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_ranges_hold_every_line_once(tmp_path, size):
    raw = b"ab\r\n\r\n c\rd\n\n  \n" + "é漢".encode() * 9 + b"\nlast"
    (tmp_path / "x").write_bytes(raw)
    found = [x for a in range(0, len(raw), size) for x in lines_of_range(str(tmp_path / "x"), a, a + size)]
    assert found == [b"ab", b" c", b"d", "é漢".encode() * 9, b"last"]


def test_line_positions_write_no_text(spark, odd_lines):
    mark = staged_so_far()
    got = position.with_line_position(odd_lines.select("text"))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert sorted(r.pos for r in got.collect()) == list(range(401))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert [spark.read.parquet(p).columns for p in staged_since(mark)] == [["file", "start", "number"]]
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("textmill_lines") == 1 and "Exchange hash" not in text


def test_scans_that_only_spark_can_number(spark, odd_lines, seven):
    json_files = position._json_files
    assert json_files(odd_lines) and json_files(odd_lines.select("n"))
    assert json_files(odd_lines.select(F.col("n").alias("m"))) is None
    assert json_files(odd_lines.where("n > 3")) is None
    assert json_files(spark.read.schema("text string").option("multiLine", True).json(seven)) is None
    assert json_files(spark.read.schema("text string").option("mode", "DROPMALFORMED").json(seven)) is None


def test_lines_that_hold_several_objects_are_refused(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a"}\n[{"text": "b"}, {"text": "c"}]\n')
    with pytest.raises(Exception, match="one object a line"):
        position.with_line_position(corpus.read_corpus(spark, str(tmp_path), "json", "text string")).collect()


def test_files_in_list_order(spark, seven):
    paths = [seven[3], seven[1], seven[3]]
    got = read_files_in_order(spark, paths, "json", "text string").orderBy("file_idx", "pos").collect()
    assert [(r.file_idx, r.text) for r in got] == [
        (k, f"{i}-{j}") for k, i in enumerate([3, 1, 3]) for j in range(3)
    ]


def test_a_directory_is_one_place_in_the_list(spark, tmp_path):
    """Its files are numbered through in name order, also where another listed file lies between them."""
    for name, ids in (("d/a", range(3)), ("d/c", range(3, 8)), ("d/b/x", range(20, 24))):
        spark.range(ids[0], ids[-1] + 1).select(F.col("id").cast("string").alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"), mode="overwrite")
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "t").glob("part-*")).rename(tmp_path / f"{name}.parquet")
    root = str(tmp_path / "d")
    inner = {"d": [*"01234567"], "d/b": ["20", "21", "22", "23"], "d/c.parquet": [*"34567"]}
    for listed in (["d"], ["d/b", "d"], ["d", "d/c.parquet", "d"]):
        paths = [str(tmp_path / p) for p in listed]
        items = indexed_datasets(spark, paths, byte_tokenizer(), "parquet", schema="text string").orderBy("file_idx", "item_idx")
        got = [(r.file_idx, r.item_idx, bytes(r.tokens).decode()) for r in items.collect()]
        assert got == [(k, i, text) for k, p in enumerate(listed) for i, text in enumerate(inner[p])]
    (tmp_path / "lines").mkdir()
    for k in range(2):
        write_lines(tmp_path / "lines" / f"{k}.jsonl", [f"{k}-{j}" for j in range(3)])
    got = read_files_in_order(spark, [f"{root}/../lines/", f"file:{tmp_path}/lines/1.jsonl"], "json", "text string")
    assert sorted((r.file_idx, r.text) for r in got.collect()) == sorted(
        [(0, f"{k}-{j}") for k in range(2) for j in range(3)] + [(1, f"1-{j}") for j in range(3)]
    )


def test_file_catalog_names(spark):
    got = files.file_catalog(spark, ["a", "b"] * 6, "out").orderBy("file_idx").collect()
    assert [r.output for r in got][9:11] == ["out_09", "out_10"]


def test_json_keys(spark):
    df = spark.createDataFrame([("a", "b")], "text string, title string")
    frames = corpus.select_keys(df, ["text", "title"])
    assert [f.first().text for f in frames.values()] == ["a", "b"]


def test_sample_kind(spark, tmp_path):
    spark.createDataFrame([([1, 2],)], "tokens array<long>").write.parquet(str(tmp_path / "p"))
    df, kind = packed.read_packed(spark, str(tmp_path / "p"))
    assert kind == "tokens" and dict(df.dtypes)["tokens"] == "array<int>"
    assert packed.sample_kind(spark.createDataFrame([("x",)], "text string")) == "text"
    with pytest.raises(ValueError):
        packed.sample_kind(spark.range(1))


def test_pairs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.bin", "a.idx", "b.bin", "b.idx"):
        (tmp_path / n).write_text("")
    listing = packed.pair_listing(spark, str(tmp_path))
    assert sorted(r.prefix for r in packed.require_pairs(listing).collect()) == ["a", "b"]
    (tmp_path / "c.idx").write_text("")
    with pytest.raises(ValueError, match="c"):
        packed.require_pairs(packed.pair_listing(spark, str(tmp_path)))


def test_complete_parts(spark, tmp_path):
    with pytest.raises(ValueError, match="no sub-datasets"):
        packed.complete_parts(spark, str(tmp_path))
    spark.range(2).write.parquet(str(tmp_path / "b"))
    spark.range(2).write.parquet(str(tmp_path / "a"))
    assert packed.complete_parts(spark, str(tmp_path)) == ["a", "b"]
    (tmp_path / "c").mkdir()
    with pytest.raises(ValueError, match="c: not completely"):
        packed.complete_parts(spark, str(tmp_path))


def test_stream_root_is_pruned(spark, tmp_path):
    df = spark.range(8).select(
        "id", F.when(F.col("id") < 6, "en").otherwise("de").alias("stream"), F.lit("train").alias("split")
    )
    df.write.partitionBy("stream", "split").parquet(str(tmp_path / "s"))
    got = streams.read_streams(spark, str(tmp_path / "s"), "train", ["en"])
    assert got.count() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [stream" in plan
    counts = streams.catalogue_counts(got, ["en", "gsw"], keep_empty=True).collect()
    assert {r.stream: r.n_samples for r in counts} == {"en": 6, "gsw": 0}


def test_tokenizer_files(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "ü": 1}), encoding="utf-8")
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b\nab c\n", encoding="utf-8")
    assert read_vocab(spark, str(tmp_path / "vocab.json")) == {"a": 0, "ü": 1}
    assert read_merges(spark, str(tmp_path / "merges.txt")) == [("a", "b"), ("ab", "c")]


def test_many_files_are_listed_at_once(spark, tmp_path):
    """Also with commas, spaces, braces and backslashes in names; folders beside files are left out."""
    odd = ["a,b.jsonl", "c d.jsonl", "e%20f.jsonl", "g+h.jsonl"]
    names = sorted([*odd, *(f"n{i:05d}.jsonl" for i in range(3000))])
    for name in names:
        (tmp_path / name).write_text('{"text": "x"}\n' if name in odd else "")
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "inner.jsonl").write_text("{}")
    want = [f"{tmp_path}/{n}" for n in names]
    started = time.perf_counter()
    assert files.expand_glob(spark, f"{tmp_path}/*.jsonl") == want
    assert files.expand_glob(spark, f"file://{tmp_path}/n0000*.jsonl") == [f"file:{tmp_path}/n0000{i}.jsonl" for i in range(10)]
    assert corpus.direct_files(spark, str(tmp_path)) == want
    assert time.perf_counter() - started < 20
    assert files.expand_glob(spark, f"{tmp_path}/none*") == []
    inner = str(tmp_path / "only")
    os.makedirs(f"{inner}/deep")
    (tmp_path / "only" / "deep" / "x.jsonl").write_text("{}")
    assert corpus.direct_files(spark, inner) == []
