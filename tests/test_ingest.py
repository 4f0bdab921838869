import json

from textmill.operators.tokenize import byte_tokenizer, tokenize
from textmill.streaming.ingest import ingest


def drop(path, texts):
    path.write_text("".join(json.dumps({"text": t}) + "\n" for t in texts), encoding="utf-8")


def test_each_file_is_taken_up_once(spark, tmp_path):
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    src.mkdir()
    drop(src / "a.jsonl", ["one", "two", ""])

    def run():
        ingest(
            spark, str(src), str(out), str(checkpoint), byte_tokenizer(), "text string", eod=256, max_files=1
        ).awaitTermination()
        return spark.read.parquet(str(out))

    assert run().count() == 3
    drop(src / "b.jsonl", ["one", "näh"])
    assert run().count() == 5
    got = run()
    assert got.count() == 5
    batch = tokenize(spark.read.schema("text string").json(str(src)), byte_tokenizer(), eod=256)
    assert sorted(r.tokens for r in got.collect()) == sorted(r.tokens for r in batch.collect())
    assert got.select("file").distinct().count() == 2
