"""SentencePiece encoding and decoding by a Viterbi search over an Aho-Corasick automaton.

The automaton holds all pieces of a model.  One pass over a text visits, for each position, the
pieces that end there by following output links, and relaxes the best score of the text so far; the
best way is read backwards at the end.  Characters that are no piece fall back to byte pieces.

The scores are those of a unigram model.  A byte-pair model gives ranks instead of log chances; they
are read as a Zipf law, ``-log(rank + 2)``.

White space is written as U+2581; the sign itself, in a text, falls back to bytes, so decoding gives
every text back exactly.  No piece crosses from a solid character to white space (checked when a
model is read), so the best way of a text is that of its words one after the other, and words are
kept once encoded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_WORDS = 1 << 18
CACHED_LENGTH = 64  # longer words are not kept
PIECE_BYTES = 1 << 20


@dataclass
class Pieces:
    """What a model says: text, score and id of each piece; ids of the 256 byte pieces."""

    pieces: list[tuple[str, float, int]]
    bytes: list[int]

    @classmethod
    def read(cls, path: str) -> Pieces:
        """From a SentencePiece model file with byte pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, byte_ids = [], {}
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((text, model.get_score(i), i))
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if not any(s != int(s) for _, s, _ in plain):  # ranks of a byte-pair model
            top = max(s for _, s, _ in plain)
            plain = [(t, -math.log(top - s + 2), i) for t, s, i in plain]
        return cls(plain, [byte_ids[b] for b in range(256)])


@dataclass
class Encoder:
    vocabulary: Pieces
    # Words encoded lately, in two generations, so that frequent ones are never dropped.
    _young: dict[str, tuple[int, ...]] = field(default_factory=dict)
    _old: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for text, score, i in self.vocabulary.pieces:
            self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        texts = [t for t, _, _ in self.vocabulary.pieces]
        self.single = {t for t in texts if len(t) == 1}
        # A byte piece costs more than any piece, so a piece is always preferred to its bytes.
        self.byte_score = min((s for _, s, _ in self.vocabulary.pieces), default=0.0) - 10.0
        self.whole = any(re.search(f"[^{MARK}]{MARK}", t) for t in texts)
        loose = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if not any(c in t for t in texts))
        self.words = re.compile(f"[{loose}]|{MARK}*[^{MARK}{loose}]+|{MARK}+" if loose else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.table: dict[int, bytes] = {i: t.replace(MARK, " ").encode() for t, _, i in self.vocabulary.pieces}
        self.table |= {i: bytes([b]) for b, i in enumerate(self.vocabulary.bytes)}

    def search(self, text: str) -> list[int]:
        """Ids of the best way through ``text``, whose white space is written as U+2581."""
        n = len(text)
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        last: list = [None] * (n + 1)
        known = self.single.issuperset(text)
        done = n if known else 0  # characters whose fall-back has been tried
        for end, (length, score, i) in self.automaton.iter(text):
            while done <= end and not known:
                self._fall_back(text, done, best, last)
                done += 1
            value = best[end + 1 - length] + score
            if value > best[end + 1]:
                best[end + 1] = value
                last[end + 1] = (length, i)
        while done < n:
            self._fall_back(text, done, best, last)
            done += 1
        out: list[int] = []
        at = n
        while at:
            length, i = last[at]
            if i is None:
                out += [self.vocabulary.bytes[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(i)
            at -= length
        out.reverse()
        return out

    def _fall_back(self, text: str, at: int, best: list[float], last: list) -> None:
        if text[at] not in self.single:
            value = best[at] + self.byte_score * len(text[at].encode())
            if value > best[at + 1]:
                best[at + 1] = value
                last[at + 1] = (1, None)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        young = self._young
        # Literal marks are bytes of their own, between the parts.
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += [self.vocabulary.bytes[b] for b in MARK.encode()]
            escaped = (MARK if not k else "") + part.replace(" ", MARK)
            for word in [escaped] if self.whole else self.words.findall(escaped):
                ids = young.get(word)
                if ids is None:
                    ids = self._old.get(word)
                    if ids is None:
                        ids = tuple(self.search(word))
                    if len(word) <= CACHED_LENGTH:
                        if len(young) >= CACHED_WORDS:
                            self._old, self._young = young, {}
                            young = self._young
                        young[word] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the white space put before a text is taken off."""
        raw = b"".join(map(self.table.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Pieces, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_pieces, pieces, round_trip)`` for every row of ``docs``.

    ``round_trip`` says whether decoding the pieces gives the text back.  Null and empty texts have
    no pieces.  Each text is encoded whole, on its own; rows may repeat; other columns are not read.
    The model's pieces, a fixed set, travel with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            lists: list[np.ndarray] = []
            trips: list[bool] = []
            size = begin = 0
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or size > PIECE_BYTES:
                    cuts = np.cumsum([0, *map(len, lists)])
                    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(begin, k - begin),
                            pa.array(np.diff(cuts).astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32())),
                            pa.array(trips, pa.bool_()),
                        ],
                        names=["doc_id", "n_pieces", "pieces", "round_trip"],
                    )
                    lists, trips, size, begin = [], [], 0, k
                if k == batch.num_rows:
                    break
                value = texts[k].as_py() or ""
                found = encoder.encode(value)
                trips.append(encoder.decode(found) == value)
                lists.append(np.array(found, dtype=np.int32))
                size += len(value)

    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, "doc_id long, n_pieces int, pieces array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: Pieces, pieces: str = "pieces") -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, pieces)``; null lists give empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [encoder.decode(x.as_py() or []) for x in part.column("pieces")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    named = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(pieces).alias("pieces"))
    return named.mapInArrow(run, "doc_id long, text string")
