"""The command lines, end to end on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textmill.jobs import evaluate, ingest, merge, mix, pack, shuffle, split, tokenize_files
from textmill.operators.indexed import indexed_datasets
from textmill.operators.tokenize import byte_tokenizer


@pytest.fixture
def corpus(spark, tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    for i in range(3):
        with open(root / f"p{i}.jsonl", "w", encoding="utf-8") as f:
            for j in range(20):
                f.write(json.dumps({"text": f"text {i} {j} " * (j + 1)}) + "\n")
    return root


def test_shuffle_job(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    shuffle.main(
        ["--glob", f"{corpus}/*.jsonl", "--input-format", "json", "--out", out, "--n-files", "4", "--emit-pos"]
    )
    df = spark.read.parquet(out)
    assert sorted(r.shuffle_pos for r in df.collect()) == list(range(60))
    assert sum(n.endswith(".zstd.parquet") for n in os.listdir(out) if n.startswith("part")) == 4
    again = str(tmp_path / "json")
    shuffle.main(["--files", out, "--out", again, "--n-files", "2", "--output-format", "json", "--layout-order"])
    assert spark.read.json(again).count() == 60


def test_pack_split_merge_mix(spark, corpus, tmp_path):
    packed = str(tmp_path / "packed")
    args = ["--path", str(corpus), "--input-format", "json", "--out", packed, "--shards", "3"]
    with pytest.raises(ValueError, match="--tokenizer"):
        pack.main([*args, "--concat-tokens", "64", "--eos-text", "\n"])
    args += ["--tokenizer", "bytes"]
    pack.main([*args, "--concat-tokens", "64", "--eos-text", "\n"])
    with pytest.raises(ValueError, match="already holds"):
        pack.main(args)
    with pytest.raises(ValueError, match="run into each other"):
        pack.main([*args[:5], str(tmp_path / "other"), *args[6:], "--concat-tokens", "64"])
    samples = spark.read.parquet(f"{packed}/train")
    total = samples.count()
    sizes = [len((f"text {i} {j} " * (j + 1)).encode()) + 1 for i in range(3) for j in range(20)]
    assert total == sum(sum(sizes[shard::3]) // 64 for shard in range(3))
    assert {len(r.tokens) for r in samples.collect()} == {64}

    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    split.main(["--path", f"{packed}/train", "--left-path", left, "--right-path", right, "--right-prob", "0.2"])
    sizes = spark.read.parquet(left).count(), spark.read.parquet(right).count()
    assert sum(sizes) == total and min(sizes) > 0

    for side, n in ((left, sizes[0]), (right, sizes[1])):  # a side has gaps; its merge has none
        merge.main(["--root", side, "--out", f"{side}-merged", "--n-files", "2"])
        rows = spark.read.parquet(f"{side}-merged").orderBy("sample").collect()
        assert [r["sample"] for r in rows] == list(range(n))
        assert [(r["shard"], r["seq"]) for r in rows] == sorted((r["shard"], r["seq"]) for r in rows)

    merged = str(tmp_path / "merged")
    merge.main(["--root", f"{packed}/train", "--out", merged, "--n-files", "2"])
    got = spark.read.parquet(merged)
    assert sorted(r["sample"] for r in got.collect()) == list(range(total))

    stream_root = str(tmp_path / "streams")
    for name in ("en", "de"):
        got.write.parquet(f"{stream_root}/stream={name}/split=train")
    (tmp_path / "mix.json").write_text(json.dumps({"streams": {"en": {"proportion": 0.75}, "de": {"proportion": 0.25}}}))
    epochs = str(tmp_path / "epochs")
    budget = str(64 * 200)
    mix.main(
        ["--root", stream_root, "--config", str(tmp_path / "mix.json"), "--out", epochs]
        + ["--token-budget", budget, "--length", "64", "--epochs", "2"]
    )
    order = spark.read.parquet(epochs)
    per = {(r.epoch, r.stream): r["count"] for r in order.groupBy("epoch", "stream").count().collect()}
    assert per == {(e, s): n for e in (0, 1) for s, n in (("en", 150), ("de", 50))}


def test_pack_of_cut_documents(spark, corpus, tmp_path):
    with open(corpus / "long.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"text": "much longer than a piece " * 400}) + "\n")
    args = ["--path", str(corpus), "--input-format", "json", "--concat-tokens", "64", "--eos-text", "\n", "--tokenizer", "bytes"]
    for no_wrap in ([], ["--no-wrap"]):
        found = []
        for name, extra in (("whole", []), ("cut", ["--piece-chars", "256"])):
            out = str(tmp_path / f"{name}{len(no_wrap)}")
            pack.main([*args, "--out", out, *extra, *no_wrap])
            found.append(sorted(map(str, spark.read.parquet(f"{out}/train").select("seq", "tokens").collect())))
        assert found[0] == found[1] and len(found[0]) > 10


def test_pack_without_concatenation(spark, corpus, tmp_path):
    out = str(tmp_path / "texts")
    pack.main(["--path", str(corpus), "--input-format", "json", "--out", out, "--split", "val"])
    df = spark.read.parquet(f"{out}/val")
    assert df.columns == ["text"] and df.count() == 60
    merged = str(tmp_path / "merged")
    merge.main(["--root", f"{out}/val", "--out", merged, "--n-files", "3"])
    assert sorted(r["sample"] for r in spark.read.parquet(merged).collect()) == list(range(60))
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    split.main(["--path", f"{out}/val", "--left-path", left, "--right-path", right, "--right-prob", "0.3"])
    assert spark.read.parquet(left).columns == ["text"]
    assert spark.read.parquet(left).count() + spark.read.parquet(right).count() == 60


def test_files_to_indexed_datasets_and_merge(spark, corpus, tmp_path):
    out = str(tmp_path / "my")
    tokenize_files.main(["--glob", f"{corpus}/*.jsonl", "--input-format", "json", "--out", out, "--append-eod"])
    names = sorted(n for n in os.listdir(f"{out}/text") if n.startswith("output="))
    assert names == [f"output=my_{i}_text_document" for i in range(3)]
    merged = str(tmp_path / "merged")
    merge.main(["--root", f"{out}/text", "--out", merged, "--indexed"])
    items = spark.read.parquet(f"{merged}/items").orderBy("merged_idx").collect()
    expected = [
        list(json.loads(line)["text"].encode()) + [256]
        for name in sorted(os.listdir(corpus))
        for line in open(corpus / name, encoding="utf-8")
    ]
    assert [r.tokens for r in items] == expected
    ends = spark.read.parquet(f"{merged}/documents").orderBy("end_idx").collect()
    assert [r.end_idx for r in ends] == list(range(61))
    with pytest.raises(ValueError, match="differ in type"):
        spark.read.parquet(f"{out}/text/output=my_1_text_document").withColumn("size", F.col("size").cast("long")).write.parquet(
            str(tmp_path / "odd" / "b")
        )
        spark.read.parquet(f"{out}/text/output=my_0_text_document").write.parquet(str(tmp_path / "odd" / "a"))
        merge.main(["--root", str(tmp_path / "odd"), "--out", str(tmp_path / "no"), "--indexed"])
    os.remove(f"{out}/text/_SUCCESS")
    with pytest.raises(ValueError, match="not completely written"):
        merge.main(["--root", f"{out}/text", "--out", str(tmp_path / "no"), "--indexed"])


def test_ingest_job(spark, corpus, tmp_path):
    args = ["--path", str(corpus), "--out", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c")]
    ingest.main([*args, "--append-eod"])
    ingest.main([*args, "--append-eod"])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 60


def test_missing_texts_take_no_item_number(spark, tmp_path):
    lines = [{"text": "a"}, {"other": 1}, {"text": ""}, {"text": None}, {"text": "bc"}]
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps(line) + "\n" for line in lines))
    items = indexed_datasets(spark, [str(path)], byte_tokenizer(), schema="text string").orderBy("item_idx")
    assert [(r.item_idx, r.size, r.tokens) for r in items.collect()] == [
        (0, 1, [97]),
        (1, 0, []),
        (2, 2, [98, 99]),
    ]


def test_evaluation_groups_and_budget(spark, tmp_path):
    rows = [("en", "train", [1, 2, 3]), ("en", "val", [4, 5]), ("de", "train", []), ("de", "val", [6]), ("fr", "val", [7])]
    df = spark.createDataFrame(rows, "stream string, split string, tokens array<int>")
    root, out = str(tmp_path / "streams"), str(tmp_path / "out")
    df.write.partitionBy("stream", "split").parquet(root)
    config = {
        "streams": {"en": {"proportion": 0.75}, "de": {"proportion": 0.25}},
        "groups": {"ALL": {"streams": ["en", "de", "fr"]}, "TWICE": {"streams": ["de"], "repeat": 2}},
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    args = ["--root", root, "--out", out, "--config", str(tmp_path / "c.json"), "--steps", "2"]
    with pytest.raises(ValueError, match="--batch"):
        evaluate.main(args)
    evaluate.main([*args, "--batch", "2", "--length", "3"])
    sizes = {r.label: (r.n_streams, r.n_samples, r.n_tokens) for r in spark.read.parquet(f"{out}/sizes").collect()}
    assert sizes == {"ALL": (3, 3, 4), "TWICE": (1, 2, 2)}
    assert spark.read.parquet(f"{out}/groups").groupBy("label").count().count() == 2
    budget = {r.stream: (r.n_tokens, r.n_needed, r.passes) for r in spark.read.parquet(f"{out}/budget").collect()}
    assert budget == {"en": (3, 9, 3.0), "de": (0, 3, None)}


def test_readme_packing_command(spark, corpus, tmp_path):
    """The command that the README shows first, with a small byte-level encoder."""
    from textmill.plans.tokens import byte_level_vocab

    vocab, merges = byte_level_vocab()
    (tmp_path / "vocab.json").write_text(json.dumps(vocab))
    (tmp_path / "merges.txt").write_text("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in merges), encoding="utf-8")
    files = f"{tmp_path}/vocab.json,{tmp_path}/merges.txt"
    out = str(tmp_path / "packed")
    pack.main(
        ["--path", str(corpus), "--input-format", "json", "--out", out, "--concat-tokens", "32"]
        + ["--tokenizer", f"bpe:{files}", "--eos-text", "<|endoftext|>", "--eos-id", "--shards", "4"]
    )
    ids = [t for r in spark.read.parquet(f"{out}/train").collect() for t in r.tokens]
    assert vocab["<|endoftext|>"] in ids
    done = str(tmp_path / "files")
    tokenize_files.main(
        ["--glob", f"{corpus}/*.jsonl", "--input-format", "json", "--out", done, "--tokenizer", f"bpe:{files}", "--append-eod"]
    )
    assert all(r.tokens[-1] == vocab["<|endoftext|>"] for r in spark.read.parquet(f"{done}/text").collect())
