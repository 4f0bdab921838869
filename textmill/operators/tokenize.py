"""Tokenising documents with a chosen tokeniser.

A :class:`Tokenizer` is a column rule plus what the driver must know about it.  Byte and
word-hash tokenisers stay on the JVM; the others are Arrow UDFs whose model is loaded once
per task.  All are map-only: no word is shuffled to be looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import workers
from textmill.functions.tokens import WORD_BREAK, byte_tokens, word_hash_tokens, wrap_document
from textmill.operators.cut import LAST_COL, PIECE_COL
from textmill.session import PIECES_BYTES_PER_CORE, SMALL_BYTES_PER_CORE, spread_if_small

TOKENS = T.ArrayType(T.IntegerType())

# The words of byte-level encoders, and the token that ends a document.
BYTE_LEVEL_WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"


@dataclass(frozen=True)
class Tokenizer:
    """``column`` maps a text column to an array of int ids."""

    column: Callable[[Column], Column]
    vocab_size: int
    bos_id: int | None = None
    eos_id: int | None = None

    def encode(self, spark: SparkSession, text: str) -> list[int]:
        """Ids of one short text, for the checks before a job."""
        return spark.createDataFrame([(text,)], "text string").select(self.column(F.col("text"))).first()[0]


def byte_tokenizer(eos_id: int | None = 256, bos_id: int | None = None) -> Tokenizer:
    size = max(256, 1 + max(eos_id or 0, bos_id or 0))
    return Tokenizer(byte_tokens, size, bos_id, eos_id)


def word_hash_tokenizer(hex_digits: int = 7) -> Tokenizer:
    return Tokenizer(lambda c: word_hash_tokens(c, hex_digits), 16**hex_digits)


def callable_tokenizer(
    load: Callable[[], Callable[[list[str]], list[list[int]]]],
    vocab_size: int,
    bos_id: int | None = None,
    eos_id: int | None = None,
) -> Tokenizer:
    """Any Python tokeniser.  ``load`` runs once per task and returns texts -> ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from workers.encode_batches(batches, load)

    udf = F.arrow_udf(run, TOKENS)
    return Tokenizer(lambda c: udf(c), vocab_size, bos_id, eos_id)


def bpe_tokenizer(
    spark: SparkSession,
    vocab: Mapping[str, int],
    merges: Sequence[tuple[str, str]],
    word_break: str = WORD_BREAK,
    to_symbols: Callable[[str], list[str]] = list,
    unk_id: int | None = None,
    eos_id: int | None = None,
) -> Tokenizer:
    """Byte-pair encoding of words from a vocabulary and ranked merges, sent as broadcasts.

    ``to_symbols`` turns a word into its starting symbols (default: its characters).
    """
    assets = spark.sparkContext.broadcast((dict(vocab), {tuple(m): r for r, m in enumerate(merges)}))

    def load():
        ids, ranks = assets.value
        breaks = re.compile(word_break)

        def encode_word(word: str) -> list[int]:
            symbols = workers.merge_pairs(to_symbols(word), ranks)
            return [ids[s] if unk_id is None else ids.get(s, unk_id) for s in symbols]

        return workers.word_encoder(lambda text: [w for w in breaks.split(text) if w], encode_word)

    return callable_tokenizer(load, 1 + max(vocab.values()), eos_id=eos_id)


def byte_level_tokenizer(
    spark: SparkSession,
    vocab: Mapping[str, int],
    merges: Sequence[tuple[str, str]],
    end_of_text: str = END_OF_TEXT,
    unk_id: int | None = None,
) -> Tokenizer:
    """Byte-pair encoding as vocabulary and merge files of byte-level encoders mean it.

    Every byte has a printable character; words keep the space before them, and no text is lost.
    Words are cut out on the JVM, and merged in the workers.  The id of ``end_of_text`` is that of
    the vocabulary.  A vocabulary without all bytes needs ``unk_id``.
    """
    symbols = workers.byte_symbols()
    missing = [s for s in symbols if s not in vocab]
    if missing and unk_id is None:
        raise ValueError(f"the vocabulary lacks {len(missing)} bytes and no unknown id is given")
    assets = spark.sparkContext.broadcast((dict(vocab), {tuple(m): r for r, m in enumerate(merges)}))

    def load():
        ids, ranks = assets.value
        spelled = workers.byte_symbols()

        def encode_word(word: str) -> list[int]:
            merged = workers.merge_pairs([spelled[b] for b in word.encode("utf-8")], ranks)
            return [ids[s] if unk_id is None else ids.get(s, unk_id) for s in merged]

        return encode_word

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from workers.encode_words(batches, load)

    udf = F.arrow_udf(run, TOKENS)
    return Tokenizer(
        lambda c: udf(F.regexp_extract_all(c, F.lit(BYTE_LEVEL_WORDS), F.lit(0))),
        1 + max(vocab.values()),
        eos_id=vocab.get(end_of_text),
    )


def decode_byte_level(vocab: Mapping[str, int], ids: Sequence[int]) -> str:
    """The text of some ids (for checks); the end token has none."""
    spelled = {i: s for s, i in vocab.items()}
    codes = {s: b for b, s in enumerate(workers.byte_symbols())}
    raw = bytes(codes[c] for i in ids if spelled[i] != END_OF_TEXT for c in spelled[i])
    return raw.decode("utf-8", "replace")


def separators(
    spark: SparkSession,
    tokenizer: Tokenizer,
    bos_text: str = "",
    eos_text: str = "",
    use_bos_id: bool = False,
    use_eos_id: bool = False,
) -> tuple[list[int], list[int]]:
    """Ids to put before and after each document.

    Fails when documents would be joined without any separating token: no separator text
    given, not both id flags set, and the tokeniser itself adds neither.
    """
    if not (bos_text + eos_text) and not (use_bos_id and use_eos_id):
        probe = tokenizer.encode(spark, "test")
        starts = bool(probe) and tokenizer.bos_id is not None and probe[0] == tokenizer.bos_id
        ends = bool(probe) and tokenizer.eos_id is not None and probe[-1] == tokenizer.eos_id
        if not (starts or ends):
            raise ValueError(
                "this tokeniser adds neither a begin nor an end token; give a separator text or "
                "ask for both separator ids, or documents will run into each other"
            )

    def ids(text: str, use_id: bool, special: int | None) -> list[int]:
        if use_id:
            if special is None:
                raise ValueError("the tokeniser has no such special token")
            return [special]
        return tokenizer.encode(spark, text) if text else []

    return ids(bos_text, use_bos_id, tokenizer.bos_id), ids(eos_text, use_eos_id, tokenizer.eos_id)


def tokenize(
    df: DataFrame,
    tokenizer: Tokenizer,
    text_col: str = "text",
    before: Sequence[int] = (),
    after: Sequence[int] = (),
    eod: int | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Add ``tokens`` (int ids) and ``n_tokens``; rows without a text are left out.

    ``before``/``after`` frame every document, also an empty one; ``eod`` ends it.  Pieces of documents
    (:func:`textmill.operators.cut.cut_texts`) are framed as the documents they are cut from.
    """
    ending = list(after) + ([eod] if eod is not None else [])
    cut = {PIECE_COL, LAST_COL} <= set(df.columns)
    ends = (F.col(PIECE_COL) == 0, F.col(LAST_COL)) if cut else ()
    ids = wrap_document(tokenizer.column(F.col(text_col)), before, ending, *ends)
    kept = [c for c in df.columns if keep_text or c != text_col]
    per_core = PIECES_BYTES_PER_CORE if cut else SMALL_BYTES_PER_CORE
    return (
        spread_if_small(df.where(F.col(text_col).isNotNull()), per_core)
        .select(*kept, ids.alias("tokens"))
        .withColumn("n_tokens", F.size("tokens").cast("long"))
    )


def as_int32(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Store ids as 32-bit integers whatever the source's integer type."""
    return df.withColumn(tokens_col, F.col(tokens_col).cast("array<int>"))


def map_partitions_of_texts(
    df: DataFrame, process: Callable, schema: T.StructType | str, columns: Sequence[str]
) -> DataFrame:
    """Run an own preprocessing function over batches of documents (``mapInPandas``)."""
    return df.select(*columns).mapInPandas(process, schema)
