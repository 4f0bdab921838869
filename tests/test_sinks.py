import os

import pytest
from pyspark.sql import functions as F

from textmill.operators.shuffle import shuffle
from textmill.operators.split import split
from textmill.sinks import write


def data_files(path):
    return sorted(n for n in os.listdir(path) if n.startswith("part-"))


def test_codecs(spark, tmp_path):
    df = spark.range(5).coalesce(1)
    cases = [
        ("parquet", None, ".zstd.parquet"),
        ("parquet", "none", ".parquet"),
        ("parquet", "", ".parquet"),
        ("parquet", "snappy", ".snappy.parquet"),
        ("json", None, ".json.gz"),
        ("json", "none", ".json"),
    ]
    for i, (fmt, codec, ending) in enumerate(cases):
        out = str(tmp_path / str(i))
        write.write_corpus(df, out, fmt, codec)
        (name,) = data_files(out)
        assert name.endswith(ending) and name.count(".") == ending.count(".")
        assert spark.read.format(fmt).load(out).count() == 5
    with pytest.raises(ValueError):
        write.write_corpus(df, str(tmp_path / "x"), "csv")


def test_file_count_and_order_of_a_shuffle(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = str(tmp_path / "s")
    write.write_corpus(shuffle(docs, 5, seed=3, key="doc_id"), out)
    names = data_files(out)
    assert len(names) == 5
    read = [r.doc_id for n in names for r in spark.read.parquet(f"{out}/{n}").select("doc_id").collect()]
    placed = shuffle(docs, 3, seed=3, key="doc_id", emit_pos=True).orderBy("shuffle_pos").collect()
    assert read == [r.doc_id for r in placed]
    write.write_corpus(docs.limit(3), out)
    assert spark.read.parquet(out).count() == 3


def test_refuse_existing(spark, tmp_path):
    root = str(tmp_path / "r")
    spark.range(2).write.parquet(f"{root}/train")
    write.refuse_existing(spark, root, ["val"])
    with pytest.raises(ValueError, match="train"):
        write.refuse_existing(spark, root, ["train", "val"])
    spark.range(2).write.parquet(f"{root}/split=val")
    with pytest.raises(ValueError, match="val"):
        write.refuse_existing(spark, root, ["val"])


def test_split_written_both_ways(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    marked = split(docs, "doc_id", right_prob=0.2)
    root = str(tmp_path / "root")
    write.write_split(marked, root)
    write.write_split_paths(marked, str(tmp_path / "l"), str(tmp_path / "r"))
    sizes = {r.split: r["count"] for r in spark.read.parquet(root).groupBy("split").count().collect()}
    assert sizes["train"] == spark.read.parquet(str(tmp_path / "l")).count()
    assert sizes["valid"] == spark.read.parquet(str(tmp_path / "r")).count()
    assert sum(sizes.values()) == 200
    with pytest.raises(ValueError):
        write.write_split(marked, root)


def test_per_file_outputs(spark, tmp_path):
    df = spark.range(30).select((F.col("id") % 11).alias("file_idx"), "id")
    out = str(tmp_path / "files")
    write.write_per_file(df, out, "corpus", 11, key="text")
    names = sorted(n for n in os.listdir(out) if n.startswith("output="))
    assert names[0] == "output=corpus_00_text_document" and len(names) == 11
    assert spark.read.parquet(out).count() == 30


def test_compacted_shards(spark, tmp_path):
    df = spark.range(100).repartition(5).select((F.col("id") % 2).alias("shard"), "id")
    files = {}
    for compact in (True, False):
        out = str(tmp_path / str(compact))
        write.write_shards(df, out, compact=compact)
        assert spark.read.parquet(out).count() == 100
        files[compact] = len(data_files(f"{out}/shard=0"))
    assert files == {True: 1, False: 5}


def test_ordered_files(spark, tmp_path):
    df = spark.range(10).repartition(4).withColumnRenamed("id", "pos")
    out = str(tmp_path / "o")
    write.write_corpus(write.in_order(df, "pos", 10, 3), out)
    parts = [[r.pos for r in spark.read.parquet(f"{out}/{n}").collect()] for n in data_files(out)]
    assert parts == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9]]


def test_epochs_are_kept(spark, tmp_path):
    order = spark.range(6).select((F.col("id") % 2).cast("int").alias("epoch"), F.col("id").alias("pos"))
    out = str(tmp_path / "e")
    write.write_epochs(order, out)
    assert write.read_epoch(spark, out, 1).count() == 3
    with pytest.raises(Exception, match="already exists"):
        write.write_epochs(order, out)


def test_a_rank_reads_its_files_only(spark, tmp_path):
    epochs = F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch")
    order = spark.range(1003).select((F.col("id") * 7).alias("sample"), F.col("id").alias("pos"), epochs)
    out = str(tmp_path / "e")
    write.write_epochs(order.repartitionByRange(4, "epoch", "pos"), out, range_rows=100)
    assert write.read_epoch(spark, out, 1).count() == 1003
    for first, last in ((0, None), (317, None), (100, 400), (990, 2000), (1003, None)):
        end = min(1003, last or 1003)
        seen = []
        for rank in range(8):
            got = write.read_epoch_slice(spark, out, 1, first, last, rank, 8)
            pos = sorted(r.pos for r in got.collect())
            ranges = {p // 100 for p in pos}
            files = [f for f in got.inputFiles() if pos]
            assert all("epoch=1" in f for f in files)
            assert {int(f.split("first_pos=")[1].split("/")[0]) // 100 for f in files} == ranges
            assert all(r.sample == 7 * r.pos and r.epoch == 1 for r in got.collect())
            seen += pos
        assert seen == list(range(first, end))
    with pytest.raises(ValueError):
        write.read_epoch_slice(spark, out, 1, rank=8, ranks=8)


def test_a_long_epoch_has_few_directories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(write, "MAX_RANGES", 8)
    order = spark.range(1003).select(F.lit(2).alias("epoch"), F.col("id").alias("pos"))
    out = str(tmp_path / "e")
    write.write_epochs(order, out, range_rows=10)
    ranges = sorted(int(n.split("=")[1]) for n in os.listdir(f"{out}/epoch=2") if n.startswith("first_pos="))
    assert ranges == list(range(0, 1003, 130))
    got = [write.read_epoch_slice(spark, out, 2, 250, None, rank, 8) for rank in range(8)]
    assert [p for df in got for p in sorted(r.pos for r in df.collect())] == list(range(250, 1003))
    assert max(len({f.split("first_pos=")[1].split("/")[0] for f in df.inputFiles()}) for df in got) <= 2


def test_a_frequent_output_is_written_by_several_tasks(spark, tmp_path):
    """Nearly all rows have one language; no task reads them all."""
    from textmill.plans import inputs

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.md5((F.col("id") * 64 + k).cast("string"))))
    lang = F.when(F.col("id") % 100 == 0, "de").otherwise("en").alias("lang")
    spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"), lang).write.parquet(f"{tmp_path}/documents.parquet")
    roots = []
    real = inputs._out
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    inputs._out = lambda *a: roots.append(real(*a)) or roots[-1]
    try:
        rows = sorted(map(tuple, inputs.outputs_refused(spark, str(tmp_path)).collect()))
    finally:
        inputs._out = real
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert rows == [("de", True, 40), ("en", True, 3960), ("none", False, 0)]
    assert spark.read.parquet(roots[0]).count() == 4000
    assert len([n for n in os.listdir(f"{roots[0]}/lang=en") if n.endswith(".parquet")]) >= 4
