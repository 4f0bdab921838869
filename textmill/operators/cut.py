"""Long texts as several rows, so that no row of token ids grows with its document.

A document becomes pieces ``(piece, last)`` that are cut where no word is, tokenised one by one, framed
as one document (:func:`textmill.operators.tokenize.tokenize`) and packed in the order of document and
piece (:func:`textmill.operators.pack.pack`): the samples are those of the uncut documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_COL, LAST_COL = "piece", "last"

# A text has less than 2^31 bytes, so pieces of at least this many characters can be counted in 24 bits.
MIN_CHARS = 128
PIECE_BITS = 24


def _pattern(chars: int, words: bool) -> str:
    """A piece: ``chars`` characters and what follows of their last word, or what is left of the text.

    A word may be cut off where white space follows it, whatever the rule for words: neither a run of white
    space nor a word with the space before it is ever torn.
    """
    if not words:
        return f"(?s).{{1,{chars}}}"
    return rf"(?sU).{{{chars}}}.*?(?:(?<=\S)(?=[ \t\r\n])|\z)|.+"


def cut_texts(df: DataFrame, chars: int, text_col: str = "text", words: bool = True) -> DataFrame:
    """Rows of pieces: ``df`` with ``text_col`` cut, the piece's number from 0 and whether it is the last.

    With ``words=False`` (characters or bytes are tokens) every piece but the last has exactly ``chars``
    characters; else a piece ends before white space, and one without any is as long as its word.
    An empty text is one empty piece; a null text has none.
    """
    if chars < MIN_CHARS:
        raise ValueError(f"pieces need at least {MIN_CHARS} characters")
    text = F.col(text_col)
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(_pattern(chars, words)), F.lit(0))
    )
    kept = [c for c in df.columns if c != text_col]
    parts = df.where(text.isNotNull()).select(*kept, cut.alias("_cut"))
    return parts.select(*kept, F.size("_cut").alias("_n"), F.posexplode("_cut").alias(PIECE_COL, text_col)).select(
        *kept, F.col(PIECE_COL).cast("long").alias(PIECE_COL), (F.col(PIECE_COL) == F.col("_n") - 1).alias(LAST_COL), text_col
    )
