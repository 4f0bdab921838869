"""Packing against a plain loop over the documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions.workers import Fill
from textmill.operators import pack as packing
from textmill.operators import position
from textmill.operators.cut import cut_texts
from textmill.operators.pack import pack, pack_report, text_samples
from textmill.operators.tokenize import byte_level_tokenizer, byte_tokenizer, tokenize, word_hash_tokenizer
from textmill.plans.tokens import byte_level_vocab
from textmill.staging import stage


def concat_and_cut(docs, length, wrap):
    """Reference rule: grow a buffer, cut samples off its front; without wrap drop what is left over."""
    out, buffer = [], []
    for tokens in docs:
        buffer = buffer + tokens
        while len(buffer) >= length:
            out.append(buffer[:length])
            buffer = buffer[length:] if wrap else []
    return out, buffer


def make_docs(seed, n, longest, shards, hot=False):
    rng = np.random.default_rng(seed)
    rows, base = [], 0
    for pos in range(n):
        size = int(rng.integers(0, longest + 1))
        shard = 0 if hot and pos % 3 == 0 else pos % shards
        rows.append((shard, pos, list(range(base, base + size))))
        base += size
    return rows


def check(spark, rows, length, wrap):
    df = spark.createDataFrame(rows, "shard long, pos long, tokens array<int>").repartition(3)
    got = {}
    for r in pack(df, length, wrap=wrap, keep_tail=True).collect():
        assert r.n_tokens == len(r.tokens)
        got.setdefault(r.shard, {})[r.seq] = r.tokens
    for shard in {r[0] for r in rows}:
        docs = [t for s, _, t in sorted(rows, key=lambda r: r[1]) if s == shard]
        whole, tail = concat_and_cut(docs, length, wrap)
        expected = whole + ([tail] if tail else [])
        mine = got.get(shard, {})
        assert sorted(mine) == list(range(len(expected)))
        assert [mine[k] for k in range(len(expected))] == expected
    full = pack(df, length, wrap=wrap).collect()
    assert all(len(r.tokens) == length for r in full)
    assert len(full) == sum(len(t) == length for s in got.values() for t in s.values())


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("block_rows", [2, 1024])
@pytest.mark.parametrize("longest,length", [(5, 16), (40, 7), (20, 1)])
def test_pack(spark, monkeypatch, wrap, block_rows, longest, length):
    monkeypatch.setattr(position, "BLOCK_ROWS", block_rows)
    check(spark, make_docs(longest, 150, longest, 3), length, wrap)


@pytest.mark.parametrize("wrap", [True, False])
def test_hot_shard(spark, monkeypatch, wrap):
    monkeypatch.setattr(position, "BLOCK_ROWS", 4)
    check(spark, make_docs(1, 200, 12, 5, hot=True), 10, wrap)


@pytest.mark.parametrize("wrap", [True, False])
def test_edges(spark, wrap):
    length = 4
    rows = [(0, 0, []), (0, 1, [7]), (0, 2, list(range(3 * length + 1))), (0, 3, list(range(length))), (1, 4, [1])]
    check(spark, rows, length, wrap)
    check(spark, [(0, 0, [1, 2])], length, wrap)
    check(spark, [(0, 9, list(range(length)))], length, wrap)


def test_documents_without_tokens(spark):
    rows = [(0, 0, None), (0, 1, [1, 2]), (0, 2, []), (0, 3, [3, 4])]
    df = spark.createDataFrame(rows, "shard long, pos long, tokens array<int>")
    assert [r.tokens for r in pack(df, 4).collect()] == [[1, 2, 3, 4]]


def test_lengths_are_read_without_tokens(spark, monkeypatch):
    rows = [(0, p, [1, 2, 3]) for p in range(9)]
    df = spark.createDataFrame(rows, "shard long, pos long, tokens array<int>")
    table = stage(df.withColumn("n_tokens", F.size("tokens").cast("long")), "pack-test")
    seen = []
    blocks = position.with_blocks

    def watched(docs, value, *rest):
        lengths = docs.groupBy("shard").agg(F.sum(value), F.max("pos"))
        seen.append(lengths._jdf.queryExecution().executedPlan().toString())
        return blocks(docs, value, *rest)

    monkeypatch.setattr(packing, "with_blocks", watched)
    assert pack(table, 9).count() == 3 and pack(table, 9, wrap=False).count() == 3
    assert len(seen) == 2 and not any("tokens:array" in text for text in seen)


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([], "shard long, pos long, tokens array<int>")
    assert pack(df, 4).count() == 0
    assert pack(df, 4, wrap=False).count() == 0
    with pytest.raises(ValueError):
        pack(df, 0)


def test_other_column_names(spark):
    df = spark.createDataFrame([("x", 1, [1, 2, 3])], "part string, nr long, ids array<int>")
    for wrap in (True, False):
        got = pack(df, 2, "part", "nr", wrap=wrap, tokens_col="ids").collect()
        assert [(r.shard, r.seq, r.tokens) for r in got] == [("x", 0, [1, 2])]


def test_report(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (1, 1, [4])], "shard long, pos long, tokens array<int>")
    got = {r.shard: r for r in pack_report(df, pack(df, 2)).collect()}
    assert (got[0].n_samples, got[0].n_packed, got[0].n_left_over) == (1, 2, 1)
    assert (got[1].n_samples, got[1].n_packed, got[1].n_left_over) == (0, 0, 1)


def test_text_samples(spark):
    df = spark.createDataFrame([("a", 1)], "body string, n int")
    assert text_samples(df, "body").columns == ["text"]


def test_fill_matches_the_loop():
    rng = np.random.default_rng(3)
    for length in (1, 5, 9):
        for _ in range(20):
            sizes = rng.integers(1, 12, size=int(rng.integers(1, 30)))
            fill = Fill(sizes, length)
            levels, closed = fill.transition()
            for start in range(length):
                level, seq, seqs, offsets = start, 0, [], []
                for n in sizes:
                    seqs.append(seq)
                    offsets.append(level)
                    level += n
                    if level >= length:
                        level, seq = 0, seq + 1
                assert (levels[start], closed[start]) == (level, seq)
                got_seq, got_offset = fill.replay(start, 0)
                assert got_seq.tolist() == seqs and got_offset.tolist() == offsets


def test_unwrapped_blocks_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    monkeypatch.setattr(position, "BLOCK_ROWS", 1)
    check(spark, make_docs(5, 90, 9, 2), 8, False)


LONG_TEXTS = [
    (0, 0, "ab " * 500),
    (1, 1, ""),
    (0, 2, None),
    (0, 3, "x" * 700 + " end"),
    (1, 4, "  lead wide  " * 90 + "\n\n"),
    (0, 5, "\u2003 \t" * 200),
    (1, 6, "é漢\U0001f600 " * 200),
    (0, 7, "word"),
    (0, 8, "it's 12,345  and " * 60),
]


@pytest.mark.parametrize("words", [True, False])
def test_pieces_are_the_text(spark, words):
    docs = spark.createDataFrame(LONG_TEXTS, "shard long, pos long, text string")
    got = {}
    for r in cut_texts(docs, 128, words=words).orderBy("pos", "piece").collect():
        assert r.piece == len(got.setdefault(r.pos, []))
        got[r.pos].append(r)
    assert {p: "".join(r.text for r in rows) for p, rows in got.items()} == {p: t for _, p, t in LONG_TEXTS if t is not None}
    for rows in got.values():
        assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
        for a, b in zip(rows, rows[1:]):
            if words:
                assert not a.text[-1].isspace() and b.text[0] in " \t\r\n"
            else:
                assert len(a.text) == 128
    with pytest.raises(ValueError):
        cut_texts(docs, 10)


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize("kind", ["bytes", "words", "byte-level"])
def test_pieces_pack_like_whole_documents(spark, monkeypatch, wrap, kind):
    monkeypatch.setattr(position, "BLOCK_ROWS", 4)
    made = {
        "bytes": lambda: byte_tokenizer(),
        "words": lambda: word_hash_tokenizer(),
        "byte-level": lambda: byte_level_tokenizer(spark, *byte_level_vocab()),
    }[kind]()
    docs = spark.createDataFrame(LONG_TEXTS, "shard long, pos long, text string").repartition(3)
    whole = pack(stage(tokenize(docs, made, before=[7], after=[8], eod=9), "whole"), 33, wrap=wrap, keep_tail=True)
    cut = tokenize(cut_texts(docs, 128, words=kind != "bytes"), made, before=[7], after=[8], eod=9)
    pieces = pack(stage(cut, "cut"), 33, wrap=wrap, keep_tail=True, piece_col="piece")
    key = ["shard", "seq", "n_tokens", "tokens"]
    assert sorted(map(tuple, pieces.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    longest = cut.agg(F.max("n_tokens")).first()[0]
    assert longest <= 1003, "a row of tokens is bounded by a piece and the word or white space at its end"


def test_no_row_holds_a_long_document(spark):
    """Ten million characters: whole, the row of ids would have ten million numbers."""
    docs = spark.range(1).select(F.lit(0).cast("long").alias("shard"), F.col("id").alias("pos"), F.expr("repeat('wörd ab ', 1250000)").alias("text"))
    tokens = stage(tokenize(cut_texts(docs, 4096, words=False), byte_tokenizer(), eod=256), "long")
    assert tokens.agg(F.max("n_tokens")).first()[0] <= 2 * 4096 + 1
    samples = pack(tokens, 2048, piece_col="piece")
    assert samples.count() == (1250000 * 9 + 1) // 2048
    assert samples.where("n_tokens <> 2048").isEmpty()
