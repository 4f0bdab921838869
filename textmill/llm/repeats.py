"""Removal of repeated passages by prefix-free parsing.

A rolling hash over every 16 bytes triggers at the leftmost smallest value of each run of 92
positions, so triggers depend on the text alone and every 200-byte string holds two of them.  The
bytes from a trigger to the next make a phrase (overlapping the next by the hash's 16 bytes).  The
dictionary of phrases is counted over all texts in one exchange of key ranges (``keyed``).

A 200-byte string is a suffix of a phrase followed by the parse from a trigger on; strings are
equal only if their phrases are.  So most strings are settled in the dictionary alone:

* a phrase that occurs once has no repeated string;
* a phrase whose whole surroundings (all strings that begin with it) are the same wherever it
  occurs has only repeated ones: equal parses take the same place in suffix order;
* elsewhere, where passages begin, end or differ, the suffixes of the dictionary and the parse
  after them are combined: suffixes that share 200 bytes are neighbours in corpus order.  Only the
  classes of equal neighbours matter here, not which class comes first, so suffixes are ordered by
  a fingerprint of their first 200 bytes, in a second exchange.

Phrases and strings have fingerprints of 64 bits, surroundings 48 beside their phrase's 64.  Matches do not cross
texts, overlaps count, and strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm import bytesops, keyed
from textmill.staging import stage

LENGTH = 200
GRAM = 16
UNIQUE, SETTLED, MIXED = 0, 1, 2
AROUND_CUT = np.uint64(16)  # 48 bits beside the phrase's 64


_PLACE_BITS = np.uint64(24)


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in every run of ``width``; values have 40 bits."""
    place = np.arange(len(values), dtype=np.uint64)
    if len(values) >> 24:  # places do not fit beside the values
        best = values
        step = 1
        while step < width:
            shift = min(step, width - step)
            take = best[shift:] < best[:-shift]
            best = np.where(take, best[shift:], best[:-shift])
            place = np.where(take, place[shift:], place[:-shift])
            step += shift
        return place.astype(np.int64)
    best = (values << _PLACE_BITS) | place
    step = 1
    while step < width:
        shift = min(step, width - step)
        best = np.minimum(best[shift:], best[:-shift])
        step += shift
    return (best & np.uint64((1 << 24) - 1)).astype(np.int64)


def parse(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of string starts that share a trigger, over many texts.

    Arrays of one entry a run: ``first`` and ``last`` start, ``row``, ``phrase`` and ``around``, the
    hashes of the phrase and of all bytes that the run's strings cover.
    """
    width = (length - GRAM) // 2
    rows = np.flatnonzero(np.diff(at) >= length)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return {"first": none, "last": none, "row": none, "phrase": none.view(np.uint64), "around": none.view(np.uint64)}
    rolling = bytesops.Rolling(data)
    trigger = _leftmost(rolling.windows(GRAM) >> _PLACE_BITS, width)
    # A run ends where the trigger changes and where a text has its last whole string.
    fresh = np.zeros(len(trigger), dtype=bool)
    fresh[1:] = trigger[1:] != trigger[:-1]
    fresh[at[rows]] = True
    first = np.flatnonzero(fresh)
    row = np.searchsorted(at, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(trigger)) - 1, at[row + 1] - length)
    whole = first <= last
    first, last, row = first[whole], last[whole], row[whole]
    own = trigger[first]
    return {
        "first": first,
        "last": last,
        "row": row,
        "phrase": rolling.ranges(own, trigger[own + 1] + GRAM),
        "around": bytesops.join_hashes([rolling.ranges(first, last + length), (own - first).astype(np.uint64)]),
    }


def _ask_phrases(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    def add(state: list, batch: pa.RecordBatch) -> None:
        for _, _, data, at in bytesops.pieces(batch.column("_text")):
            runs = parse(data, at, length)
            state.append((runs["phrase"], runs["around"] >> AROUND_CUT))

    def end(split: int, state: list) -> pa.RecordBatch:
        phrase = np.concatenate([p for p, _ in state]) if state else np.zeros(0, np.uint64)
        around = np.concatenate([a for _, a in state]) if state else np.zeros(0, np.uint64)
        order = np.argsort(phrase, kind="stable")
        phrase, around = phrase[order], around[order]
        fresh = np.ones(len(phrase), dtype=bool)
        fresh[1:] = phrase[1:] != phrase[:-1]
        begin = np.flatnonzero(fresh)
        if not len(begin):
            return keyed.asked(split, phrase, [phrase, phrase.astype(np.uint8)], bits)
        low, high = np.minimum.reduceat(around, begin), np.maximum.reduceat(around, begin)
        count = np.diff(np.append(begin, len(phrase)))
        # What this split knows: once, more than once all alike, more than once and not alike.
        seen = np.where(low != high, 2, np.where(count > 1, 1, 0)).astype(np.uint8)
        return keyed.asked(split, phrase[begin], [low, seen], bits)

    yield from keyed.per_split(batches, list, add, end)


def _judge_phrases(group: keyed.Group) -> np.ndarray:
    times = np.diff(np.append(group.starts, len(group.order)))
    seen = group.highest(1)
    code = np.where((times > 1) | (seen > 0), SETTLED, UNIQUE)
    code[(seen == 2) | (group.lowest(0) != group.highest(0))] = MIXED
    return code.astype(np.uint8)[group.of]


def _ask_strings(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    def add(state: list, batch: pa.RecordBatch) -> None:
        for hashes, _ in _strings(pa.Table.from_batches([batch]), length):
            state.append(np.unique(hashes, return_counts=True))

    def end(split: int, state: list) -> pa.RecordBatch:
        keys, counts = keyed.distinct([k for k, _ in state], [c for _, c in state])
        return keyed.asked(split, keys, [np.minimum(counts, 2).astype(np.uint8)], bits)

    yield from keyed.per_split(batches, list, add, end)


def _strings(table: pa.Table, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and starts of the open strings of each text; ``_open`` lists first and last starts."""
    for text, runs in zip(table["_bytes"], table["_open"]):
        data = _unpacked(text)
        pairs = np.asarray(runs.as_py(), dtype=np.int64).reshape(-1, 2)
        starts = _spread(pairs[:, 0], pairs[:, 1])
        yield bytesops.Rolling(data, bytesops.BASE_2).ranges(starts, starts + length), starts


def _unpacked(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(text.as_py()), dtype=np.uint8)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in order."""
    count = last - first + 1
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


def _covered(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Marks the bytes under strings that start in the ranges."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(data: np.ndarray, gone: np.ndarray, keep: bool) -> tuple:
    kept = data[~gone].tobytes() if gone.any() else data.tobytes()
    n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep else None


_DIGEST = [
    ("n_bytes", pa.int64(), T.LongType()),
    ("n_removed", pa.int64(), T.LongType()),
    ("n_spans", pa.int64(), T.LongType()),
    ("kept_sha256", pa.string(), T.StringType()),
    ("_kept", pa.string(), T.StringType()),
]


def _digest_columns(found: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*found)) or [()] * len(_DIGEST)
    return [pa.array(c, type=kind) for c, (_, kind, _) in zip(columns, _DIGEST)]


def _apply_phrases(left: pa.Table, right: pa.Table, carried: list[str], length: int, keep: bool) -> pa.Table:
    """Texts whose strings are all settled are done; the others keep their bytes and open runs."""
    column = left["_text"]
    known = keyed.distinct([np.unique(parse(data, at, length)["phrase"]) for _, _, data, at in bytesops.pieces(column)])[0]
    verdict = keyed.aligned(right, np.uint8)
    digests, texts, opens, sets = [], [], [], []
    packer = zstandard.ZstdCompressor(level=3)
    for first_row, last_row, data, at in bytesops.pieces(column):
        p = parse(data, at, length)
        code = verdict[np.searchsorted(known, p["phrase"])] if len(p["phrase"]) else np.zeros(0, np.uint8)
        cuts = np.searchsorted(p["row"], np.arange(last_row - first_row + 1))
        for r in range(last_row - first_row):
            own = slice(cuts[r], cuts[r + 1])
            body = data[at[r] : at[r + 1]]
            first, last, c = p["first"][own] - at[r], p["last"][own] - at[r], code[own]
            if (c == MIXED).any():
                digests.append((len(body), None, None, None, None))
                texts.append(packer.compress(body.tobytes()))
                opens.append(np.c_[first[c == MIXED], last[c == MIXED]].ravel())
                sets.append(np.c_[first[c == SETTLED], last[c == SETTLED]].ravel())
            else:
                gone = _covered(len(body), first[c == SETTLED], last[c == SETTLED], length)
                digests.append(_digest(body, gone, keep))
                texts.append(None)
                opens.append(None)
                sets.append(None)
    ints = pa.list_(pa.int32())
    return pa.table(
        [*[left[c] for c in carried], *_digest_columns(digests), pa.array(texts, pa.binary()), pa.array(opens, ints), pa.array(sets, ints)],
        names=[*carried, *[n for n, *_ in _DIGEST], "_bytes", "_open", "_set"],
    )


def _apply_strings(left: pa.Table, right: pa.Table, carried: list[str], length: int, keep: bool) -> pa.Table:
    known = keyed.distinct([np.unique(h) for h, _ in _strings(left, length)])[0]
    again = keyed.aligned(right, np.uint8)
    digests = []
    # The hashes are worked out again rather than held for all texts of the split.
    for (hashes, starts), text, settled in zip(_strings(left, length), left["_bytes"], left["_set"]):
        data = _unpacked(text)
        hit = starts[again[np.searchsorted(known, hashes)] > 0]
        pairs = np.asarray(settled.as_py(), dtype=np.int64).reshape(-1, 2)
        gone = _covered(len(data), np.r_[hit, pairs[:, 0]], np.r_[hit, pairs[:, 1]], length)
        digests.append(_digest(data, gone, keep))
    return pa.table(
        [*[left[c] for c in carried], *_digest_columns(digests)], names=[*carried, *[n for n, *_ in _DIGEST]]
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """``docs`` with every byte removed that a string of ``length`` bytes covers which starts elsewhere too.

    All columns of ``docs`` stay; ``text`` is replaced by what is left (null texts: empty), or left
    out unless ``keep_text``.  Added: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (those
    of the same names are replaced).  Bytes that are cut inside a character are decoded with
    replacement signs in ``text``; the hash is that of the bytes.  Rows that repeat repeat each
    other's text.  An empty table gives an empty table.
    """
    carried = [c for c in docs.columns if c != text and c not in {n for n, *_ in _DIGEST}]
    names = [f"_c{i}" for i in range(len(carried))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], F.col(f"`{text}`").alias("_text"))
    bits = keyed.bucket_bits(docs)
    fields = [f for f in renamed.schema.fields if f.name != "_text"]
    digest = [T.StructField(n, kind) for n, _, kind in _DIGEST]
    ints = T.ArrayType(T.IntegerType())

    placed = keyed.by_split(renamed)
    questions = placed.select(keyed.SPLIT, "_text").mapInArrow(
        bytesops.released_batches(lambda b: _ask_phrases(b, length, bits)), keyed.ASKED
    )
    verdicts = keyed.answers(questions, [np.uint64, np.uint8], _judge_phrases)
    first = stage(
        placed.groupBy(keyed.SPLIT)
        .cogroup(verdicts.groupBy(keyed.SPLIT))
        .applyInArrow(
            bytesops.released_pair(lambda left, right: _apply_phrases(left, right, names, length, keep_text)),
            T.StructType(
                [*fields, *digest, T.StructField("_bytes", T.BinaryType()), T.StructField("_open", ints), T.StructField("_set", ints)]
            ),
        ),
        "phrases",
    )
    still_open = keyed.by_split(first.where("_open is not null").drop(*[n for n, *_ in _DIGEST]))
    asked = still_open.select(keyed.SPLIT, "_bytes", "_open").mapInArrow(
        bytesops.released_batches(lambda b: _ask_strings(b, length, bits)), keyed.ASKED
    )
    again = keyed.answers(asked, [np.uint8], lambda g: (g.total(0) > 1).astype(np.uint8)[g.of])
    second = still_open.groupBy(keyed.SPLIT).cogroup(again.groupBy(keyed.SPLIT)).applyInArrow(
        bytesops.released_pair(lambda left, right: _apply_strings(left, right, names, length, keep_text)),
        T.StructType([*fields, *digest])
    )
    done = first.where("_open is null").select(*names, *[n for n, *_ in _DIGEST]).unionByName(second)
    back = dict(zip(carried, names))
    columns = [
        F.col("_kept").alias(text)
        if c == text
        else F.col(back[c]).alias(c)
        for c in docs.columns
        if c in back or (c == text and keep_text)
    ]
    return done.select(*columns, *[n for n, *_ in _DIGEST if n != "_kept"])
