"""Token columns computed without leaving the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates words.  An explicit class, because the meaning of \s differs
# between regular-expression engines.
WORD_BREAK = "[ \t\r\n]+"

INT_ARRAY = "array<int>"


def no_tokens() -> Column:
    return F.array().cast(INT_ARRAY)


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes 0..255 of the text.

    Reading the bytes as Latin-1 gives one character per byte, whose code point is the byte;
    splitting that string is linear, unlike indexed substrings of the encoded text.
    """
    per_byte = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    ids = F.transform(per_byte, lambda c: F.ascii(c))
    return F.when(text == "", no_tokens()).otherwise(ids)


def words(text: Column) -> Column:
    """Non-empty words in text order."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def word_hash_tokens(text: Column, hex_digits: int = 7) -> Column:
    """One id per word: the leading hex digits of the word's MD5 (7 digits: 28-bit ids)."""
    return F.transform(
        words(text), lambda w: F.conv(F.substring(F.md5(w), 1, hex_digits), 16, 10).cast("int")
    )


def wrap_document(
    tokens: Column,
    before: Sequence[int],
    after: Sequence[int],
    first: Column | None = None,
    last: Column | None = None,
) -> Column:
    """Put fixed ids before and after each document's own tokens.

    Rows that are pieces of documents get them where ``first`` and ``last`` hold.
    """

    def frame(ids: Sequence[int], where: Column | None) -> Column:
        made = F.array(*[F.lit(int(t)) for t in ids])
        return made if where is None else F.when(where, made).otherwise(no_tokens())

    parts = [tokens]
    if before:
        parts.insert(0, frame(before, first))
    if after:
        parts.append(frame(after, last))
    return F.concat(*parts) if len(parts) > 1 else tokens


def fingerprint(tokens: Column) -> Column:
    """MD5 of the ids joined by commas: a scalar that stands for a token array."""
    return F.md5(F.array_join(tokens.cast("array<string>"), ","))
