"""Small helpers that run inside Python workers.

This module is pickled by value with the functions that use it, so executors need no copy
of the package.  It imports nothing from the package.
"""

from __future__ import annotations

import heapq
import sys
from array import array
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Bytes of text that are Python objects at a time, however large the batches are.
SLICE_BYTES = 1 << 18

# The same for lists of words, of which only the distinct ones are made: the more at a time, the fewer.
WORDS_BYTES = 1 << 20


def slices(batch: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Runs of consecutive rows with about ``most`` bytes in all, at least one row each; none is copied.

    Rows are counted by their own bytes, a list of words as its words and their offsets.
    """
    listed = pa.types.is_list(batch.type) or pa.types.is_large_list(batch.type)
    most = most or (WORDS_BYTES if listed else SLICE_BYTES)
    rows = len(batch)
    if not rows:
        yield batch
        return
    ends = _offsets(batch)
    if listed:
        ends = _offsets(batch.values, ends) + 8 * ends
    first = 0
    while first < rows:
        stop = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        stop = min(rows, max(first + 1, stop))
        yield batch.slice(first, stop - first)
        first = stop


def _offsets(array: pa.Array, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Where the values of each row begin, and those of the last end; or those of some ``rows`` only."""
    wide = pa.types.is_large_list(array.type) or pa.types.is_large_string(array.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    held = array.buffers()[1]
    if held is None or not held.size:
        return np.zeros(len(array) + 1, np.int64)[rows]
    return np.frombuffer(held, kind, len(array) + 1, array.offset * kind.itemsize)[rows].astype(np.int64)


def encode_batches(
    batches: Iterator[pa.Array], load: Callable[[], Callable[[list[str]], list[list[int]]]]
) -> Iterator[pa.Array]:
    """Encode Arrow batches of texts with an encoder that is loaded once per task.

    A batch is encoded and given back slice by slice: only one slice is Python objects at a time."""
    encode = load()
    for batch in batches:
        for rows in slices(batch):
            texts = rows.to_pylist()
            encoded = iter(encode([t for t in texts if t is not None]))
            yield pa.array([None if t is None else next(encoded) for t in texts], pa.list_(pa.int32()))


def encode_words(
    batches: Iterator[pa.Array], load: Callable[[], Callable[[str], list[int]]], remember: int = 1 << 17
) -> Iterator[pa.Array]:
    """Encode Arrow batches of word lists with an encoder of words that is loaded once per task.

    A batch is encoded and given back slice by slice, and of a slice only its distinct words become Python objects.
    Words are kept in two generations, so that frequent ones stay known; long words are not kept."""
    encode = load()
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def ids_of(word: str) -> bytes:
        nonlocal young, old
        got = young.get(word)
        if got is None:
            got = old.get(word)
            if got is None:
                got = array("i", encode(word)).tobytes()
            if len(word) <= REMEMBERED_CHARS:
                if len(young) >= remember:
                    old, young = young, {}
                young[word] = got
        return got

    for batch in batches:
        for rows in slices(batch):
            # A row with more words than a slice is encoded in runs of as many; their ids follow each other.
            words, run = rows.flatten(), WORDS_BYTES // 8
            parts = [_word_ids(words.slice(k, run), ids_of) for k in range(0, max(1, len(words)), run)]
            ids, n_ids = (np.concatenate(found) for found in zip(*parts))
            word_ends = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0))])
            ends = np.concatenate([[0], np.cumsum(n_ids)])[word_ends].astype(np.int32)
            yield pa.ListArray.from_arrays(ends, ids, mask=rows.is_null())


def _word_ids(words: pa.Array, ids_of: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some words one after the other, and how many each word has; equal words are looked up once."""
    coded = words.dictionary_encode()
    distinct = [ids_of(word) for word in coded.dictionary.to_numpy(zero_copy_only=False)]
    which = coded.indices.to_numpy()
    held = np.frombuffer(b"".join(distinct), np.intc)
    sizes = np.fromiter(map(len, distinct), np.int32, len(distinct)) // held.itemsize
    firsts = np.cumsum(sizes) - sizes
    n_ids = sizes[which]
    # The place of each id in `held`: counted on from the first of its word.
    places = np.arange(n_ids.sum()) + np.repeat(firsts[which] - np.cumsum(n_ids) + n_ids, n_ids)
    return held[places], n_ids


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it has a visible form in
    Latin-1, else the next free one from code 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    codes = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}
    return [chr(codes[b]) for b in range(256)]


# Words of more symbols are merged with a heap; words of more characters are not remembered.
SHORT_WORD = 48
REMEMBERED_CHARS = 64


def merge_pairs(symbols: list[str], ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging of one word: always the best-ranked neighbouring pair, everywhere."""
    if len(symbols) > SHORT_WORD:
        return merge_long(symbols, ranks)
    none = len(ranks)
    symbols = list(symbols)
    found = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
    while found and (best := min(found)) < none:
        # Left to right; a pair that a merge makes has another rank, and is looked at in a later round.
        for _ in range(found.count(best)):
            if best not in found:
                break
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = ranks.get((symbols[i], symbols[i + 1]), none)
    return symbols


def merge_long(symbols: list[str], ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """The same in n log n steps: symbols are linked, and a heap holds the ranked pairs by rank and place.

    All pairs of the best rank are merged, left to right, before the pairs that this makes are looked at.
    """
    n = len(symbols)
    held: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    while heap:
        best = heap[0][0]
        touched: set[int] = set()
        while heap and heap[0][0] == best:
            _, i = heapq.heappop(heap)
            j = after[i]
            # A pair may have been broken up since it was noted.
            if held[i] is None or j >= n or ranks.get((held[i], held[j])) != best:
                continue
            held[i] += held[j]
            held[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            touched.add(i)
            if before[i] >= 0:
                touched.add(before[i])
        for i in touched:
            if held[i] is not None and after[i] < n:
                rank = ranks.get((held[i], held[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i))
    return [s for s in held if s is not None]


_HEX = [f"{b:02x}" for b in range(256)]


def hex_bytes(word: str) -> list[str]:
    """Starting symbols of byte-level encoding: two hex digits per UTF-8 byte, one string for equal bytes."""
    return [_HEX[b] for b in word.encode("utf-8")]


def word_encoder(
    split: Callable[[str], list[str]],
    encode_word: Callable[[str], list[int]],
    remember: int = 1 << 18,
) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of texts that encodes each distinct word once (until its memory is full); long words are not kept."""
    known: dict[str, list[int]] = {}

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            ids: list[int] = []
            for word in split(text):
                got = known.get(word)
                if got is None:
                    got = encode_word(word)
                    if len(word) <= REMEMBERED_CHARS:
                        if len(known) >= remember:
                            known.clear()
                        known[word] = got
                ids.extend(got)
            out.append(ids)
        return out

    return encode


class Fill:
    """Filling samples of ``length`` with whole documents, seen from any starting level.

    ``sizes`` are consecutive document lengths.  A document that brings the level to
    ``length`` is cut there, closes the sample, and the next document opens the next one.
    So from an empty sample at document ``i`` the closing document is the first whose
    cumulated size reaches ``length``, which a search in the cumulated sizes finds.
    """

    def __init__(self, sizes: np.ndarray, length: int):
        self.length = length
        self.ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.n = len(sizes)

    def closing(self, first: np.ndarray | int, level: np.ndarray | int) -> np.ndarray:
        """Document that closes the sample which holds ``level`` tokens before ``first``."""
        goal = self.ends[first] + self.length - np.asarray(level, dtype=np.int64)
        return np.searchsorted(self.ends, goal, side="left") - 1

    def transition(self) -> tuple[np.ndarray, np.ndarray]:
        """For every starting level: the level after the last document, and samples closed."""
        # From an empty sample at document i: the document after the closing one, and so on by
        # doubling the steps; where no document closes it, i stays.
        here = np.arange(self.n + 1)
        after = np.append(self.closing(here[:-1], 0) + 1, self.n)
        open_ = after > self.n
        open_[self.n] = True
        to, closed = np.where(open_, here, after), (~open_).astype(np.int64)
        for _ in range(max(1, self.n).bit_length()):
            closed = closed + closed[to]
            to = to[to]
        level = self.ends[self.n] - self.ends[to]
        start = np.arange(self.length)
        after = self.closing(0, start) + 1
        done = after <= self.n
        at = np.where(done, after, self.n)
        levels = np.where(done, level[at], start + self.ends[self.n])
        return levels.astype(np.int32), np.where(done, closed[at] + 1, 0).astype(np.int64)

    def replay(self, level: int, seq: int) -> tuple[np.ndarray, np.ndarray]:
        """Sample number and offset in the sample of every document, from a known start."""
        firsts, first, at = [0], 0, level
        while first < self.n:
            first, at = int(self.closing(first, at)) + 1, 0
            if first < self.n:
                firsts.append(first)
        firsts = np.asarray(firsts)
        sample = np.searchsorted(firsts, np.arange(self.n), side="right") - 1
        offset = self.ends[:-1] - self.ends[firsts[sample]] + np.where(sample == 0, level, 0)
        return seq + sample, offset


def block_transition(pdf: pd.DataFrame, shard: str, order: str, length: int) -> pd.DataFrame:
    """One row per block: its effect on every starting level."""
    sizes = pdf.sort_values(order)["n_tokens"].to_numpy()
    level, closed = Fill(sizes, length).transition()
    first = pdf.iloc[0]
    return pd.DataFrame({shard: [first[shard]], "_block": [first["_block"]], "_level": [level], "_closed": [closed]})


def compose_blocks(pdf: pd.DataFrame, shard: str) -> pd.DataFrame:
    """The effect of consecutive blocks, one after the other, as that of a single one."""
    pdf = pdf.sort_values("_block", ignore_index=True)
    level = closed = None
    for after, count in zip(pdf["_level"], pdf["_closed"]):
        if level is None:
            level, closed = np.asarray(after), np.asarray(count)
        else:
            level, closed = np.asarray(after)[level], closed + np.asarray(count)[level]
    first = pdf.iloc[0]
    return pd.DataFrame({shard: [first[shard]], "_block": [first["_parent"]], "_level": [level], "_closed": [closed]})


def chain_blocks(pdf: pd.DataFrame, shard: str) -> pd.DataFrame:
    """Starting level and sample number of consecutive blocks, from those of the first."""
    pdf = pdf.sort_values("_block", ignore_index=True)
    levels, seqs = [], []
    level, seq = int(pdf["_from"].iloc[0]), int(pdf["_seq"].iloc[0])
    for after, closed in zip(pdf["_level"], pdf["_closed"]):
        levels.append(level)
        seqs.append(seq)
        level, seq = int(after[level]), seq + int(closed[level])
    return pdf[[shard, "_block"]].assign(_from=levels, _seq=seqs)


def place_documents(pdf: pd.DataFrame, shard: str, order: str, length: int) -> pd.DataFrame:
    """Sample, offset and kept length of each document of a block."""
    pdf = pdf.sort_values(order, ignore_index=True)
    sizes = pdf["n_tokens"].to_numpy()
    seq, offset = Fill(sizes, length).replay(int(pdf["_from"].iloc[0]), int(pdf["_seq"].iloc[0]))
    return pdf[[shard, order]].assign(seq=seq, _lo=offset, _kept=np.minimum(sizes, length - offset))
