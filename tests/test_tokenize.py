import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions import workers
from textmill.operators import tokenize as tk
from textmill.operators.audit import padded_vocab, text_audit, token_range_audit
from textmill.operators.cut import cut_texts
from textmill.plans.tokens import MERGES, small_vocab

TEXTS = ["", "a", "Straße – naïve 🙂\n\ttab", " lead  and trail ", "zero\x00byte", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r.tokens for r in df.collect()}


def test_bytes(texts):
    got = by_id(tk.tokenize(texts, tk.byte_tokenizer()))
    assert got == {i: list(t.encode()) for i, t in enumerate(TEXTS) if t is not None}


def test_bytes_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in tk.tokenize(docs, tk.byte_tokenizer(), keep_text=True).select("text", "tokens").collect():
        assert bytes(r.tokens).decode() == r.text


def test_empty_documents_are_framed_and_null_ones_left_out(texts):
    got = tk.tokenize(texts, tk.byte_tokenizer(), before=[300], after=[301], eod=302)
    tokens = by_id(got)
    assert tokens[0] == [300, 301, 302] and 5 not in tokens
    audit = text_audit(texts).first()
    assert (audit.n_documents, audit.n_null, audit.n_empty) == (6, 1, 1)


def test_word_hash(texts):
    tokens = by_id(tk.tokenize(texts, tk.word_hash_tokenizer()))
    assert {i: len(ids) for i, ids in tokens.items()} == {i: len(t.split()) for i, t in enumerate(TEXTS) if t is not None}


def test_merge_pairs():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "c"): 2}
    assert workers.merge_pairs(list("aaaaa"), ranks) == ["aa", "aaa"]
    assert workers.merge_pairs(list("abc"), ranks) == ["a", "bc"]
    assert workers.merge_pairs([], ranks) == []


def merged_by_passes(symbols, ranks):
    """The rule, word for word: find the best pair, merge it everywhere from the left, start again."""
    while True:
        pairs = [p for p in zip(symbols, symbols[1:]) if p in ranks]
        if not pairs:
            return symbols
        best, out = min(pairs, key=ranks.get), []
        while symbols:
            if tuple(symbols[:2]) == best:
                out, symbols = [*out, symbols[0] + symbols[1]], symbols[2:]
            else:
                out, symbols = [*out, symbols[0]], symbols[1:]
        symbols = out


def test_long_words_merge_like_short_ones():
    """Also with merges in an order that no training gives (a pair ranked above those it is made of)."""
    rng = random.Random(4)
    for _ in range(300):
        letters = "abc"[: rng.randint(1, 3)]
        made, ranks = list(letters), {}
        for _ in range(rng.randint(0, 12)):
            pair = rng.choice(made), rng.choice(made)
            ranks.setdefault(pair, 0)
            made.append("".join(pair))
        ranks = {p: i for i, p in enumerate(rng.sample(list(ranks), len(ranks)))}
        word = rng.choices(letters, k=rng.randint(0, 90))
        want = merged_by_passes(list(word), ranks)
        assert workers.merge_long(list(word), ranks) == want and workers.merge_pairs(list(word), ranks) == want


def test_a_word_of_200000_letters():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("abc", "abc"): 2, ("d", "a"): 3, ("a", "a"): 4, ("aa", "aa"): 5}
    word = random.Random(1).choices("aabcd", k=200_000)
    started = time.perf_counter()
    merged = workers.merge_pairs(word, ranks)
    assert time.perf_counter() - started < 5 and "".join(merged) == "".join(word)


def test_long_words_are_not_remembered():
    seen = []

    def encode_word(word):
        seen.append(word)
        return [len(word)]

    encode = workers.word_encoder(str.split, encode_word)
    long = "x" * (workers.REMEMBERED_CHARS + 1)
    assert encode([f"ab {long} ab {long}"]) == [[2, 65, 2, 65]]
    assert seen == ["ab", long, long]


def test_small_vocabulary(spark):
    vocab = {c: i for i, c in enumerate("abcdefgh")} | {"ab": 8, "abc": 9, "de": 10, "<unk>": 11}
    tokenizer = tk.bpe_tokenizer(spark, vocab, [("a", "b"), ("ab", "c"), ("d", "e")], unk_id=11)
    df = spark.createDataFrame([(0, "abcde  hab"), (1, "xyz"), (2, ""), (3, None)], "doc_id long, text string")
    assert by_id(tk.tokenize(df, tokenizer)) == {0: [9, 10, 7, 8], 1: [11, 11, 11], 2: []}


def test_byte_level_encoding_agrees_with_a_library(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    symbols = {s: i for i, s in enumerate(small_vocab())}
    # One private-use character per symbol stands for the hex codes in the other library.
    char = {f"{b:02x}": chr(0xE000 + b) for b in range(256)}

    def spell(symbol):
        return "".join(char[symbol[i : i + 2]] for i in range(0, len(symbol), 2))

    model = tokenizers.models.BPE(
        {spell(s): i for s, i in symbols.items()}, [(spell(a), spell(b)) for a, b in MERGES]
    )
    other = tokenizers.Tokenizer(model)
    ours = by_id(tk.tokenize(docs, tk.bpe_tokenizer(spark, small_vocab(), MERGES, to_symbols=workers.hex_bytes)))
    for r in docs.limit(20).collect():
        expected = []
        for word in r.text.split():
            expected += other.encode("".join(char[h] for h in workers.hex_bytes(word))).ids
        assert ours[r.doc_id] == expected


def test_own_callable(spark):
    def load():
        return lambda texts: [[len(t)] for t in texts]

    df = spark.createDataFrame([(0, "abc"), (1, None), (2, "")], "doc_id long, text string")
    assert by_id(tk.tokenize(df, tk.callable_tokenizer(load, 10))) == {0: [3], 2: [0]}


def test_own_preprocessing(spark):
    def halves(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["text"].str[: 2])

    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    got = tk.map_partitions_of_texts(df, halves, "doc_id long, text string", ["doc_id", "text"])
    assert got.first().text == "ab"


def test_separator_check(spark):
    plain = tk.byte_tokenizer(eos_id=256, bos_id=257)
    with pytest.raises(ValueError, match="run into each other"):
        tk.separators(spark, plain)
    with pytest.raises(ValueError):
        tk.separators(spark, plain, use_eos_id=True)
    assert tk.separators(spark, plain, use_bos_id=True, use_eos_id=True) == ([257], [256])
    assert tk.separators(spark, plain, bos_text="<s>") == (list(b"<s>"), [])
    assert tk.separators(spark, plain, eos_text="x", use_bos_id=True) == ([257], [ord("x")])
    framing = tk.Tokenizer(lambda c: F.concat(plain.column(c), F.array(F.lit(256))), 257, eos_id=256)
    assert tk.separators(spark, framing) == ([], [])
    with pytest.raises(ValueError, match="no such special"):
        tk.separators(spark, tk.word_hash_tokenizer(), eos_text="x", use_bos_id=True)


def test_range_audit(spark):
    df = spark.createDataFrame([([0, 127],), ([5],), ([],)], "tokens array<int>")
    assert padded_vocab(100) == 128 and padded_vocab(129) == 256
    assert token_range_audit(df, 100).first().fits
    assert not token_range_audit(df.union(df.limit(0)).union(df.selectExpr("array(128)")), 100).first().fits
    wide = spark.createDataFrame([([1, 2],)], "tokens array<long>")
    assert dict(tk.as_int32(wide).dtypes)["tokens"] == "array<int>"


def test_byte_level_encoding_keeps_every_text(spark):
    from textmill.operators.tokenize import END_OF_TEXT, byte_level_tokenizer, decode_byte_level, tokenize
    from textmill.plans.tokens import byte_level_vocab

    vocab, merges = byte_level_vocab()
    tokenizer = byte_level_tokenizer(spark, vocab, merges)
    assert tokenizer.eos_id == vocab[END_OF_TEXT]
    texts = ["the  therein\n\n tête über 漢字 it's 12 3", "", " ", None, " x\t y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["tokens"] for r in tokenize(df, tokenizer).collect()}
    assert {i: decode_byte_level(vocab, ids) for i, ids in got.items()} == {i: t for i, t in enumerate(texts) if t is not None}
    assert vocab["Ġthe"] in got[0]
    with pytest.raises(ValueError, match="lacks"):
        byte_level_tokenizer(spark, {"a": 0}, [])


def test_a_batch_is_encoded_in_slices(monkeypatch):
    """However many rows a batch has, only some of its texts are Python objects at a time."""
    texts = [None if i % 7 == 0 else "é" * (i % 50) for i in range(2000)] + ["x" * 5000, ""]
    seen = []

    def encode(some):
        seen.append(sum(len(t.encode()) for t in some))
        return [[ord(c) for c in t] for t in some]

    monkeypatch.setattr(workers, "slices", lambda batch, cut=workers.slices: cut(batch, 1000))
    for batch in (pa.array(texts, pa.large_string()), pa.array(texts).slice(3, 1500), pa.array([], pa.string())):
        made = list(workers.encode_batches(iter([batch]), lambda: encode))
        wanted = [None if t is None else [ord(c) for c in t] for t in batch.to_pylist()]
        assert [ids for part in made for ids in part.to_pylist()] == wanted
    assert len(seen) > 50 and sorted(seen)[-2] <= 1000 and max(seen) == 5000


def test_lists_of_words_are_encoded_in_slices(monkeypatch):
    words = [None if i % 9 == 0 else [f"w{i % 13}", "ü"] * (i % 20) for i in range(1000)]
    monkeypatch.setattr(workers, "slices", lambda batch, cut=workers.slices: cut(batch, 500))
    for batch in (pa.array(words), pa.array(words).slice(11, 700)):
        made = list(workers.encode_words(iter([batch]), lambda: lambda word: [*word.encode()]))
        wanted = [None if row is None else [b for w in row for b in w.encode()] for row in batch.to_pylist()]
        assert [ids for part in made for ids in part.to_pylist()] == wanted
        assert len(made) > 20 and max(map(len, made)) < 100


def test_few_words_of_a_slice_are_objects():
    """Memory follows the distinct words, not the occurrences, also where one row is longer than a slice."""
    rows = [["abc", "bcde"] * 600_000, None, [], ["bc", "é"] * 10, [f"{i}" for i in range(200)] * 1000]
    batch = pa.array(rows)
    asked = []

    def load():
        return lambda word: asked.append(word) or [*word.encode()]

    tracemalloc.start()
    made = list(workers.encode_words(iter([batch]), load))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [ids for part in made for ids in part.to_pylist()] == [
        None if row is None else [b for w in row for b in w.encode()] for row in rows
    ]
    assert len(asked) == 204 and peak < 80 << 20


def test_pieces_of_a_larger_table_stay_where_they_are(spark, sf, monkeypatch):
    """Ids of pieces are many times their texts: dealt out to a task a core, they would not fit in memory."""
    pieces = cut_texts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), 4096)

    def exchanges():
        made = tk.tokenize(pieces, tk.byte_tokenizer(), eod=256)
        return made._jdf.queryExecution().optimizedPlan().toString().count("Repartition")

    assert exchanges() == 1
    size = int(str(pieces._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tk, "PIECES_BYTES_PER_CORE", size // cores // 2)
    assert size < cores * tk.SMALL_BYTES_PER_CORE and exchanges() == 0


def test_remembered_words_are_few_and_small():
    words = [[f"{i:x} {i}" for i in range(k, k + 1000)] for k in range(0, 400_000, 1000)]
    batch = pa.array(words)
    tracemalloc.start()
    for part in workers.encode_words(iter([batch]), lambda: lambda word: [ord(c) * 1000 for c in word]):
        assert part.type == pa.list_(pa.int32())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_equal_bytes_of_a_word_are_one_string():
    symbols = workers.hex_bytes("äz" * 1000)
    assert symbols[:3] == ["c3", "a4", "7a"] and len({id(s) for s in symbols}) == 3
