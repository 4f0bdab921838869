"""Global facts about hashed keys, asked for by whole file splits at once.

Operators need to know, for millions of keys a task, how often each occurs in all the data.  A row
per key would be shuffled and joined; here a task sends each range of key space *one* row with its
distinct keys, sorted and packed, and gets the answers back in the same order.  A key that fills a
third of the data is sent at most once per split, so hot keys make no hot partitions, and a task
holds no more than its share of the key space.

A split is the piece of a file that one task reads; its id is made from the file's name and the
start of the piece, so a second scan, also after a lost executor, has the same splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.bytesops import released
from textmill.session import shuffle_width
from textmill.staging import stage

SPLIT = "_split"
_MOVED = re.compile(
    r"Join|Aggregate|Repartition|Rebalance|Window|Sort|Union|MapIn|Generate|Limit|LocalRelation|LogicalRDD|Sample|Distinct|Python|Range"
)
ASKED = f"{SPLIT} long, bucket int, keys binary, facts array<binary>"
ANSWERED = f"{SPLIT} long, bucket int, answer binary, sums array<long>"


def by_split(df: DataFrame) -> DataFrame:
    """``df`` with the id of each row's file split; a frame that is no plain file scan is written first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not df.inputFiles() or _MOVED.search("\n".join(x.strip(" +-:")[:20] for x in plan.split("\n"))):
        df = stage(df, "splits")
    return df.withColumn(SPLIT, F.expr("xxhash64(input_file_name(), input_file_block_start())"))


def bucket_bits(df: DataFrame) -> int:
    """Key ranges: a power of two, at least the session's shuffle partitions."""
    return max(1, (shuffle_width(df) - 1).bit_length())


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; small numbers take little room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def range_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each key range begins among sorted keys, and where the last ends."""
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def question_rows(split: int, rows: list[tuple[int, bytes, list[bytes]]]) -> pa.RecordBatch:
    """Rows ``(bucket, packed keys, packed facts)`` of one split."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), split, dtype=np.int64)),
            pa.array([b for b, _, _ in rows], pa.int32()),
            pa.array([k for _, k, _ in rows], pa.binary()),
            pa.array([f for _, _, f in rows], pa.list_(pa.binary())),
        ],
        names=[SPLIT, "bucket", "keys", "facts"],
    )


def asked(split: int, keys: np.ndarray, facts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Rows that ask about the sorted distinct ``keys`` of one split, with facts about each key."""
    cuts = range_cuts(keys, bits)
    return question_rows(
        split,
        [
            (int(b), pack_keys(keys[cuts[b] : cuts[b + 1]]), [pack(f[cuts[b] : cuts[b + 1]]) for f in facts])
            for b in np.flatnonzero(np.diff(cuts))
        ],
    )


class Group:
    """All that was asked about one key range: ``keys`` distinct and sorted, facts by occurrence."""

    def __init__(self, table: pa.Table, kinds: list):
        table = table.sort_by([(SPLIT, "ascending")])
        runs = [unpack_keys(b.as_py()) for b in table["keys"]]
        self.sizes = [len(r) for r in runs]
        every = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        fresh = np.ones(len(ranked), dtype=bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        self.keys = ranked[fresh]
        self.starts = np.flatnonzero(fresh)
        self.order = order
        self.of = np.empty(len(every), dtype=np.int64)  # occurrence -> place among the keys
        self.of[order] = np.cumsum(fresh) - 1
        facts = table["facts"].to_pylist()
        self.facts = [
            np.concatenate([unpack(f[i], kind) for f in facts]) if facts else np.zeros(0, kind)
            for i, kind in enumerate(kinds)
        ]

    def total(self, i: int) -> np.ndarray:
        return np.add.reduceat(self.facts[i][self.order], self.starts)

    def lowest(self, i: int) -> np.ndarray:
        return np.minimum.reduceat(self.facts[i][self.order], self.starts)

    def highest(self, i: int) -> np.ndarray:
        return np.maximum.reduceat(self.facts[i][self.order], self.starts)

    def first(self) -> np.ndarray:
        """Marks the first occurrence of every key."""
        mark = np.zeros(len(self.of), dtype=bool)
        mark[self.order[self.starts]] = True
        return mark


def answers(
    questions: DataFrame,
    kinds: list,
    answer: Callable[[Group], np.ndarray],
    sums: Callable[[Group], np.ndarray] | None = None,
) -> DataFrame:
    """``answer`` gives a number per occurrence, in the order of ``Group.of``; they go back by split.

    ``sums`` gives a few totals of each key range, as a list in one of its rows (``totals`` adds them up).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(SPLIT, "ascending")])
        group = Group(table, kinds)
        found = np.split(answer(group), np.cumsum(group.sizes)[:-1])
        noted = [None] * table.num_rows
        if sums:
            noted[0] = sums(group).tolist()
        return pa.table(
            [
                table[SPLIT],
                table["bucket"],
                pa.array([pack(x) for x in found], pa.binary()),
                pa.array(noted, pa.list_(pa.int64())),
            ],
            names=[SPLIT, "bucket", "answer", "sums"],
        )

    return questions.groupBy("bucket").applyInArrow(released(run), ANSWERED)


def totals(replies: DataFrame, n: int) -> list[int]:
    """The ``sums`` of all key ranges, added up."""
    found = replies.where("sums is not null").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(n)]).first()
    return [int(x or 0) for x in found]


def aligned(table: pa.Table, kind) -> np.ndarray:
    """Answers of one split in the order of its sorted distinct keys."""
    table = table.sort_by([("bucket", "ascending")])
    found = [unpack(x.as_py(), kind) for x in table["answer"]]
    return np.concatenate(found) if found else np.zeros(0, kind)


def per_split(batches: Iterator[pa.RecordBatch], start: Callable, add: Callable, end: Callable) -> Iterator:
    """Feeds the rows of each split to its own state; a task may hold several small splits in turn."""
    split, state = None, None
    for batch in batches:
        ids = batch.column(SPLIT).to_numpy()
        if not len(ids):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if split is None or ids[a] != split:
                if state is not None:
                    yield end(int(split), state)
                split, state = ids[a], start()
            add(state, batch.slice(a, b - a))
    if state is not None:
        yield end(int(split), state)


def distinct(parts: list[np.ndarray], *weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sum of each weight."""
    if not parts:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in weights])
    keys = np.concatenate(parts)
    if not weights:
        keys.sort()
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        return (keys[fresh],)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(fresh)
    sums = [np.add.reduceat(np.concatenate(w)[order], starts) if len(keys) else np.zeros(0, np.int64) for w in weights]
    return (keys[starts], *sums)
