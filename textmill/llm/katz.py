"""Scores of texts under a Katz back-off model of word pairs.

Counts of words and of pairs come from one exchange of key ranges (``keyed``) over the training
texts; a table of them, divided by split and key range, is written.  Counts up to five are
discounted by Good-Turing; what the pairs of a history leave over goes to the unseen ones by a
back-off weight

    a(h) = (1 - sum of P*(w|h)) / (1 - sum of P(w)),  sums over the pairs seen after h,

with P*(w|h) = d(c) c / (c(h) + 1/2) and P(w) = d(c) c / (N + 1/2); the half keeps something over
where every count is too high for a discount.  What words leave over is the chance of one unknown
word.  So each history's chances add up to one.  Sums for a(h) are put together in a second
exchange: each distinct pair is counted by one split that holds it.

The chance of a token is P*(w|h) if the pair was seen, else a(h) P(w) (a(h) = 1 for an unseen h).
A text is its words and one end; the end also stands before the first word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops, keyed
from textmill.staging import stage

DISCOUNTED = 5  # counts up to here are discounted
END = np.uint64(0x6A09E667F3BCC909)
WORDS, PAIRS = 1, 2
_RAN = "n_tokens long, n_known long, base_score double, score double"


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every token and of its history, and the text it belongs to."""
    data = bytesops.lower(data)
    starts, ends, row = bytesops.words(data, at)
    n_rows = len(at) - 1
    word = bytesops.Rolling(data).ranges(starts, ends)
    per_row = np.bincount(row, minlength=n_rows) + 1
    stops = np.cumsum(per_row) - 1
    key = np.full(len(word) + n_rows, END)
    inner = np.ones(len(key), dtype=bool)
    inner[stops] = False
    key[inner] = word
    history = np.empty_like(key)
    history[1:] = key[:-1]
    history[:1] = END
    return key, history, np.repeat(np.arange(n_rows), per_row)


def pair_keys(history: np.ndarray, key: np.ndarray) -> np.ndarray:
    return bytesops.join_hashes([history ^ np.uint64(0x2545F4914F6CDD1D), key])


def _ask_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    def add(state: list, batch: pa.RecordBatch) -> None:
        taught = ~np.asarray(batch.column("held_out").to_pylist(), dtype=bool)
        for first, _, data, at in bytesops.pieces(batch.column("text")):
            key, history, row = tokens(data, at)
            weight = taught[first + row].astype(np.int64)
            for kind, keys in ((WORDS, key), (PAIRS, pair_keys(history, key))):
                found, counts = keyed.distinct([keys], [weight])
                state.append((kind, found, counts))

    def end(split: int, state: list) -> pa.RecordBatch:
        merged = [keyed.distinct([k for s, k, _ in state if s == kind], [c for s, _, c in state if s == kind]) for kind in (WORDS, PAIRS)]
        keys = np.concatenate([k for k, _ in merged])
        counts = np.concatenate([c for _, c in merged])
        kinds = np.repeat(np.array([WORDS, PAIRS], dtype=np.uint8), [len(k) for k, _ in merged])
        order = np.argsort(keys, kind="stable")
        return keyed.asked(split, keys[order], [counts[order].astype(np.uint32), kinds[order]], bits)

    yield from keyed.per_split(batches, list, add, end)


def _counts(group: keyed.Group) -> np.ndarray:
    """Total count, times two, plus one at the one place that stands for the key."""
    return (2 * group.total(0).astype(np.int64)[group.of] + group.first()).astype(np.uint64)


def _sums(group: keyed.Group) -> np.ndarray:
    """Tokens, then how many words and pairs have counts of any, 1, 2, ... DISCOUNTED + 1."""
    total, kind = group.total(0).astype(np.int64), group.highest(1)
    out = [int(total[kind == WORDS].sum())]
    for k in (WORDS, PAIRS):
        own = total[kind == k]
        out += [int((own > 0).sum()), *[int((own == r).sum()) for r in range(1, DISCOUNTED + 2)]]
    return np.array(out, dtype=np.int64)


def discounts(count_of_counts: list[int]) -> list[float]:
    """Katz's factors for counts 1 to DISCOUNTED from the numbers of keys with counts 1, 2, ...

    A factor that the counts cannot give (too little data) is 1.
    """
    n = count_of_counts
    k = DISCOUNTED
    if not n[0]:
        return [1.0] * k
    cut = (k + 1) * n[k] / n[0]
    found = []
    for r in range(1, k + 1):
        turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 1.0
        d = (turing - cut) / (1 - cut) if cut < 1 else 1.0
        found.append(d if 0 < d < 1 else 1.0)
    return found


@dataclass
class Totals:
    tokens: int
    words: int
    word_discounts: list[float]
    pair_discounts: list[float]
    unknown: float

    @classmethod
    def of(cls, sums: list[int]) -> Totals:
        n, words, pairs = sums[0], sums[1 : DISCOUNTED + 3], sums[DISCOUNTED + 3 :]
        factors = discounts(words[1:])
        low = sum(r * words[r] for r in range(1, DISCOUNTED + 1))
        taken = sum(d * r * words[r] for r, d in enumerate(factors, 1)) + (n - low)
        return cls(n, words[0], factors, discounts(pairs[1:]), 1 - taken / (n + 0.5))


def _discounted(counts: np.ndarray, factors: list[float]) -> np.ndarray:
    table = np.array([0.0, *[r * d for r, d in enumerate(factors, 1)]])
    return np.where(counts <= DISCOUNTED, table[np.minimum(counts, DISCOUNTED)], counts.astype(float))


def _add(target: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    distinct, inverse = np.unique(places, return_inverse=True)
    target[distinct] += np.bincount(inverse, values, minlength=len(distinct))


def _score(left: pa.Table, right: pa.Table, totals: Totals, bits: int) -> pa.Table:
    """Rows of texts with what is known so far, and rows that ask for the split's back-off weights."""
    split = left[keyed.SPLIT][0].as_py()
    parts = []
    for first, _, data, at in bytesops.pieces(left["text"]):
        key, history, _ = tokens(data, at)
        parts.append(keyed.distinct([key, pair_keys(history, key)])[0])
    known = keyed.distinct(parts)[0]
    del parts
    reply = keyed.aligned(right, np.uint64)
    count, own = (reply >> np.uint64(1)).astype(np.int64), (reply & np.uint64(1)).astype(bool)
    seen_mass, word_mass = np.zeros(len(known)), np.zeros(len(known))
    wanted = np.zeros(len(known), dtype=bool)
    out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
    pending: list[np.ndarray] = []
    end_place = np.searchsorted(known, END)
    for first, last, data, at in bytesops.pieces(left["text"]):
        key, history, row = tokens(data, at)
        n_rows = last - first
        u = np.searchsorted(known, key)
        h = np.empty_like(u)
        h[1:] = u[:-1]
        h[:1] = end_place
        b = np.searchsorted(known, pair_keys(history, key))
        cu, cb, ch = count[u], count[b], count[h]
        p = np.where(cu > 0, _discounted(cu, totals.word_discounts) / (totals.tokens + 0.5), totals.unknown)
        direct = _discounted(cb, totals.pair_discounts)
        with np.errstate(divide="ignore"):
            value = np.log10(np.where(cb > 0, direct / (ch + 0.5), p))
        open_ = (cb == 0) & (ch > 0)
        mine = np.flatnonzero(own[b] & (cb > 0))
        if len(mine):
            places, firsts = np.unique(b[mine], return_index=True)
            mine = mine[firsts]
            own[places] = False
            _add(seen_mass, h[mine], direct[mine])
            _add(word_mass, h[mine], p[mine])
        wanted[h[open_]] = True
        out["n_tokens"].append(np.bincount(row, minlength=n_rows))
        out["n_known"].append(np.bincount(row, cu > 0, minlength=n_rows).astype(np.int64))
        base = np.log10((cu + 1) / (totals.tokens + totals.words + 1))
        out["base_score"].append(np.bincount(row, base, minlength=n_rows))
        out["score"].append(np.bincount(row, value, minlength=n_rows))
        cuts = np.searchsorted(row[open_], np.arange(1, n_rows))
        pending += np.split(h[open_].astype(np.int32), cuts)
    asked_for = np.flatnonzero(wanted | (seen_mass > 0))
    place = np.zeros(len(known), dtype=np.int32)
    place[asked_for] = np.arange(len(asked_for))
    ask = keyed.asked(split, known[asked_for], [seen_mass[asked_for], word_mass[asked_for], count[asked_for].astype(np.uint32)], bits)
    n, m = left.num_rows, ask.num_rows
    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    texts = {
        keyed.SPLIT: left[keyed.SPLIT],
        "doc_id": left["doc_id"],
        "held_out": left["held_out"],
        **{c: pa.array(np.concatenate(v), type=kinds[c]) for c, v in out.items()},
        "pending": pa.array([keyed.pack(place[x]) if len(x) else None for x in pending], pa.binary()),
    }
    questions = {c: ask.column(c) for c in ask.schema.names}
    names = [*texts, "bucket", "keys", "facts"]
    schema = _SCORED
    columns = []
    for name in names:
        kind = schema.field(name).type
        a = texts.get(name, pa.nulls(n, kind))
        b = questions.get(name, pa.nulls(m, kind))
        chunks = [*(a.chunks if isinstance(a, pa.ChunkedArray) else [a]), b]
        columns.append(pa.chunked_array([c.cast(kind) for c in chunks], type=kind))
    return pa.table(columns, names=names)


_SCORED = pa.schema(
    [
        (keyed.SPLIT, pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
        ("pending", pa.binary()),
        ("bucket", pa.int32()),
        ("keys", pa.binary()),
        ("facts", pa.list_(pa.binary())),
    ]
)


def _weights(group: keyed.Group) -> np.ndarray:
    """log10 of the back-off weight at every place where it was asked for."""
    left_over = 1 - group.total(0) / (group.highest(2).astype(float) + 0.5)
    return np.log10(left_over / np.maximum(1 - group.total(1), 1e-12))[group.of]


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    weight = keyed.aligned(right, np.float64)
    extra = [float(weight[keyed.unpack(x.as_py(), np.int32)].sum()) if x.is_valid else 0.0 for x in left["pending"]]
    score = np.asarray(left["score"]) + np.array(extra)
    return pa.table(
        [*[left[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")], pa.array(score)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def katz_scores(docs: DataFrame, held_out, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``held_out`` is a boolean column: such rows are scored and teach nothing (null: false).  Null and
    empty texts are an end alone.  Rows may repeat and then count as often.  Scores are log10; the
    base is add-one over words.  Other columns are not read.
    """
    bits = keyed.bucket_bits(docs)
    named = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text")
    )
    placed = keyed.by_split(named)
    questions = placed.mapInArrow(bytesops.released_batches(lambda batches: _ask_counts(batches, bits)), keyed.ASKED)
    counts = stage(keyed.answers(questions, [np.uint32, np.uint8], _counts, _sums), "katz-counts")
    totals = Totals.of(keyed.totals(counts, 2 * DISCOUNTED + 5))
    scored = stage(
        placed.groupBy(keyed.SPLIT)
        .cogroup(counts.groupBy(keyed.SPLIT))
        .applyInArrow(
            bytesops.released_pair(lambda left, right: _score(left, right, totals, bits)),
            f"{keyed.SPLIT} long, doc_id long, held_out boolean, {_RAN}, pending binary, bucket int, keys binary, facts array<binary>",
        ),
        "katz-scores",
    )
    asked = scored.where("bucket is not null").select(keyed.SPLIT, "bucket", "keys", "facts")
    weights = stage(keyed.answers(asked, [np.float64, np.float64, np.uint32], _weights), "katz-weights")
    texts = scored.where("bucket is null").drop("bucket", "keys", "facts")
    done = texts.groupBy(keyed.SPLIT).cogroup(weights.groupBy(keyed.SPLIT)).applyInArrow(
        _finish, f"doc_id long, held_out boolean, {_RAN}"
    )
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
