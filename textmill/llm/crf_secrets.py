"""Secrets in texts: patterns, and a linear-chain conditional random field that adds to them.

Three patterns (assignments to a password-like name, access keys, long hexadecimal runs) give the base
spans.  They also label the field's training data: windows around base spans, around other long mixed
tokens, and at places chosen by a hash.  The field tags tokens as begin, inside or outside of a secret
from their shape, the neighbouring words and shapes, and features of the whole file; it is decoded by
Viterbi over whole texts.  In half of the training windows the neighbouring words are taken from elsewhere,
and in half all but a coarse shape is hidden, so that words and shape each have to be able to tell a
secret alone: a field that only knows the patterns' own wording would add nothing to them.

A token is a run of ASCII letters and digits and of non-ASCII characters, or any other single character
that is no white space.  Tokens whose tag is certainly "outside" are found first, by a bound on what
any run of other tags through them could gain; Viterbi is run on what lies between them, so its result
is that of a run over the whole text.

``WINDOWS`` bounds the windows of each kind that are learnt from, taken in the order of a hash from all
texts; scoring covers every token of every text.

Null texts are empty; they and empty texts have no spans.  Rows that repeat an id or a text are each
scored; null ids stay.  Ties between tags go to "outside", then "begin".  An empty table gives an
empty result (nothing to learn from gives a field that tags all outside).  A text is handled whole by
one task, with some 100 bytes of memory a byte for the very longest.  Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.bytesops import Rolling, lower, mix, pieces, released_batches

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api")  # every assignment holds one of them
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Training windows of each kind, and bytes on each side of their middle.
WINDOWS = 1000
REACH = 160
# Start of a hard window: a token with a digit, or a very long one, outside all base spans.
HARD_MIXED, HARD_LONG = 6, 20
PASSES = 80
PARTS = 256

O, B, I = 0, 1, 2  # noqa: E741
TABLE_BITS = 18
SLOTS = 15
WORDS, PAIRS, FORMS = (1, 2, 3, 4, 5), (9, 14), (0, 6, 7, 8, 9, 10, 11)  # slots of a kind
RIDGE = 0.1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 digit, 2 upper, 3 lower, 4 not ASCII
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64, 128])
_LONG_WORD = 12  # longer tokens are known by their shape only


@dataclass
class Field:
    """Weights of the features by tag, and of the steps between tags."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((1 << TABLE_BITS, 3), np.float32))
    step: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))


def _runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of ``inside`` that do not cross the offsets ``at``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.zeros(len(inside) + 1, bool)
    edges[at] = True
    first = inside & (np.r_[True, ~inside[:-1]] | edges[:-1])
    last = inside & (np.r_[~inside[1:], True] | edges[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def base_spans(data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text, ``(start, kind, end, value start, value end)`` in bytes of the text, sorted."""
    found: list[list] = [[] for _ in range(len(at) - 1)]
    starts, ends = _runs(_HEX[data], at)
    long = ends - starts >= MIN_HEX
    starts, ends = starts[long], ends[long]
    for row, s, e in zip((np.searchsorted(at, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
        s, e = s - int(at[row]), e - int(at[row])
        found[row].append((s, 2, e, s, e))
    whole = data.tobytes()
    small = whole.lower()
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if any(small.find(name, a, b) >= 0 for name in NAMES):
            for m in ASSIGN.finditer(whole[a:b]):
                if m.end(2) - m.start(2) >= MIN_VALUE:
                    found[row].append((m.start(), 0, m.end(), m.start(2), m.end(2)))
        if whole.find(b"AKIA", a, b) >= 0:
            for m in ACCESS.finditer(whole[a:b]):
                if m.end() - m.start() >= MIN_ACCESS:
                    found[row].append((m.start(), 1, m.end(), m.start(), m.end()))
        found[row].sort()
    return found


def file_codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number per text for its length and its shares of digits and of signs."""
    size = np.diff(at)
    kinds = _CLASS[data]
    digits = np.diff(np.concatenate([[0], np.cumsum(kinds == 1, dtype=np.int64)])[at])
    signs = np.diff(np.concatenate([[0], np.cumsum((kinds == 0) & ~_SPACE[data], dtype=np.int64)])[at])
    share = np.maximum(size, 1)
    return (
        np.searchsorted([200, 2000, 20000], size, "right")
        + 4 * np.searchsorted([0.01, 0.05], digits / share, "right")
        + 12 * np.searchsorted([0.02, 0.05, 0.1], signs / share, "right")
    )


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token."""
    word = _CLASS[data] > 0
    starts, ends = _runs(word, at)
    signs = np.flatnonzero(~word & ~_SPACE[data])
    starts = np.concatenate([starts, signs])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([ends, signs + 1])[order]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for the form of every token.

    Fine: length, shares of digits and capitals, hexadecimal or not, changes of class, non-ASCII or not.
    Coarse: few classes of length, of digits and of changes.
    """
    kinds = _CLASS[data]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
        return sums[ends] - sums[starts]

    size = ends - starts
    digits, upper, other = count(kinds == 1), count(kinds == 2), count(kinds == 4)
    turns = np.zeros(len(data), bool)
    turns[1:] = kinds[1:] != kinds[:-1]
    changes = count(turns) - turns[starts]
    code = np.searchsorted(_LENGTHS, size, "right")
    code = code * 5 + np.searchsorted([0.0, 0.25, 0.6, 1.0], digits / size, "left") % 5
    code = code * 4 + np.where(upper == 0, 0, np.where(upper == size, 3, np.where(upper == 1, 1, 2)))
    code = code * 2 + (count(_HEX[data]) == size)
    code = code * 5 + np.where(changes < 2, changes, 2 + np.searchsorted([0.25, 0.5], changes / size, "right"))
    coarse = np.searchsorted([8, 16, 24, 48], size, "right") * 3 + np.where(digits == 0, 0, np.where(digits < size, 1, 2))
    coarse = coarse * 3 + np.where(changes < 2, 0, np.where(8 * changes < size, 1, 2))
    return (code * 2 + (other > 0)).astype(np.uint64), coarse.astype(np.uint64)


def features(data: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and row of every token, and the places of its features in the table ``[slot, token]``."""
    starts, ends, row = tokens(data, at)
    n = len(starts)
    if not n:
        return starts, ends, row, np.zeros((SLOTS, 0), np.int32)
    shape, coarse = _shapes(data, starts, ends)
    word = Rolling(lower(data)).ranges(starts, ends)
    word[ends - starts > _LONG_WORD] = 1

    def near(values: np.ndarray, k: int) -> np.ndarray:
        """Value of the token ``k`` further on in the same text, else 0."""
        moved = np.zeros(n, np.uint64)
        if abs(k) < n:
            if k > 0:
                moved[:-k] = np.where(row[k:] == row[:-k], values[k:], 0)
            else:
                moved[-k:] = np.where(row[:k] == row[-k:], values[:k], 0)
        return moved

    before, after = near(word, -1), near(word, 1)
    shape_before, shape_after = near(shape + np.uint64(1), -1), near(shape + np.uint64(1), 1)
    pair = shape << np.uint64(20)
    columns = [
        word,
        before,
        near(word, -2),
        near(word, -3),
        near(word, -4),
        after,
        shape,
        shape_before,
        shape_after,
        mix(before) + pair,
        pair + codes[row].astype(np.uint64),
        pair + shape_after,
        np.zeros(n, np.uint64),
        coarse,
        mix(before) + (coarse << np.uint64(20)),
    ]
    out = np.empty((SLOTS, n), np.int32)
    for k, column in enumerate(columns):
        out[k] = mix(column * np.uint64(SLOTS) + np.uint64(k)) >> np.uint64(64 - TABLE_BITS)
    return starts, ends, row, out


def scores(model: Field, places: np.ndarray) -> np.ndarray:
    """Sum of the features' weights, ``[token, tag]``."""
    total = np.zeros((places.shape[1], 3), np.float32)
    for slot in places:
        total += model.emit[slot]
    return total


def viterbi(emit: np.ndarray, step: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Best tags of the sequences ``[starts, ends)``, each between two tokens that are outside."""
    tags = np.zeros(len(emit), np.int8)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    if not len(size):
        return tags
    best = step[O] + emit[starts]
    back = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
        paths = best[:live, :, None] + step
        back.append(paths.argmax(1))
        best[:live] = paths.max(1) + emit[starts[:live] + t]
    tag = (best + step[:, O]).argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        tags[starts[:live] + t] = tag[:live]
        if t:
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]
    return tags


def decode(emit: np.ndarray, step: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Best tags of all texts.

    A run of tags other than outside gains at most ``entry`` and, for each token, ``gain``.  A token for
    which no run through it can gain anything is outside on a best path; what is left is cut there.
    """
    n = len(emit)
    if not n:
        return np.zeros(0, np.int8)
    emit = emit.astype(np.float64)
    stay = step[1:, 1:].max() - step[O, O]
    entry = step[O, 1:].max() + step[1:, O].max() - 2 * step[O, O] - stay
    gain = np.concatenate([[0.0], np.cumsum(emit[:, 1:].max(1) - emit[:, O] + stay)])
    most = np.maximum.accumulate(gain[1:][::-1])[::-1] - np.minimum.accumulate(gain[:-1])
    open_ = most + entry > -1e-6
    edges = np.flatnonzero(np.diff(row)) + 1
    return viterbi(emit, step, *_runs(open_, np.concatenate([[0], edges, [n]])))


def blurred(places: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The features of tokens, some of them changed by the last two bits of their windows' keys.

    With the first bit the neighbouring words are those of another token, with the second all forms but
    the coarse one are hidden (-1).
    """
    places = places.copy()
    moved, bare = np.flatnonzero(key & 1), np.flatnonzero(key & 2)
    other = np.random.default_rng(len(key)).permutation(moved)
    for slot in WORDS:
        places[slot, moved] = places[slot, other]
    for slot in PAIRS:
        places[slot, moved] = -1
    for slot in FORMS:
        places[slot, bare] = -1
    return places


def fit(places: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray, passes: int = PASSES) -> Field:
    """Maximum-likelihood weights (with a ridge) by full-batch adaptive gradient steps.

    ``places`` may hold -1 for a feature that is hidden; sequences are ``[starts, ends)``.
    """
    if not len(tags):
        return Field()
    used, index = np.unique(places, return_inverse=True)
    index = index.reshape(places.shape)
    shown = used >= 0
    weights, step = np.zeros((len(used), 3)), np.zeros((3, 3))
    squares, step_squares = np.full_like(weights, 1e-8), np.full_like(step, 1e-8)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    lives = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]
    truth = np.eye(3)[tags]
    true_steps = np.zeros((3, 3))
    np.add.at(true_steps, (np.full(len(starts), O), tags[starts]), 1)
    np.add.at(true_steps, (tags[starts + size - 1], np.full(len(starts), O)), 1)
    inner = np.ones(len(tags), bool)
    inner[starts] = False
    follow = np.flatnonzero(inner)
    np.add.at(true_steps, (tags[follow - 1], tags[follow]), 1)
    flat = index.ravel()
    for _ in range(passes):
        emit = np.zeros((len(tags), 3))
        for slot in index:
            emit += weights[slot]
        chance, steps = _expected(emit, step, starts, size, lives)
        wrong = chance - truth
        slope = np.stack([np.bincount(flat, np.tile(wrong[:, y], SLOTS), len(used)) for y in range(3)], 1)
        slope += RIDGE * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
        weights[~shown] = 0
        slope = steps - true_steps + RIDGE * step
        step_squares += slope * slope
        step -= 0.5 * slope / np.sqrt(step_squares)
    model = Field(step=step)
    model.emit[used[shown]] = weights[shown]
    return model


def _expected(emit, step, starts, size, lives) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each tag of each token, and expected number of each step, by forward and backward sums."""
    move = np.exp(step)
    local = np.exp(emit - emit.max(1, keepdims=True))
    ahead, behind = np.zeros_like(local), np.zeros_like(local)
    for t, live in enumerate(lives):
        now = starts[:live] + t
        reached = (ahead[now - 1] @ move if t else np.tile(move[O], (live, 1))) * local[now]
        ahead[now] = reached / reached.sum(1, keepdims=True)
    last = starts + size - 1
    behind[last] = move[:, O]
    for t in range(len(lives) - 1, 0, -1):
        now = starts[: lives[t]] + t
        back = (behind[now] * local[now]) @ move.T
        behind[now - 1] = back / back.sum(1, keepdims=True)
    chance = ahead * behind
    chance /= chance.sum(1, keepdims=True)
    steps = np.zeros((3, 3))
    steps[O] += chance[starts].sum(0)
    steps[:, O] += chance[last].sum(0)
    for t in range(1, len(lives)):
        now = starts[: lives[t]] + t
        both = ahead[now - 1][:, :, None] * move * (behind[now] * local[now])[:, None, :]
        steps += (both / both.sum((1, 2), keepdims=True)).sum(0)
    return chance, steps


def hard_places(data: np.ndarray, at: np.ndarray, base: list[list]) -> dict[int, int]:
    """For each text that has one, where its first token lies that looks odd and is in no base span."""
    kinds = _CLASS[data]
    starts, ends = _runs((kinds > 0) & (kinds < 4), at)
    digits = np.concatenate([[0], np.cumsum(kinds == 1)])
    size = ends - starts
    odd = (size >= HARD_LONG) | ((size >= HARD_MIXED) & (digits[ends] > digits[starts]))
    starts, ends = starts[odd], ends[odd]
    found: dict[int, int] = {}
    for row, s, e in zip((np.searchsorted(at, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
        if row not in found:
            s, e = s - int(at[row]), e - int(at[row])
            if not any(x[0] < e and s < x[2] for x in base[row]):
                found[row] = s
    return found


def _windows(text: bytes, spans: list, hard: int | None, key: int) -> Iterator[tuple[str, int, int]]:
    """Kind and byte range of up to three training windows of a text."""

    def around(middle: int) -> tuple[int, int]:
        a, b = max(0, middle - REACH), min(len(text), middle + REACH)
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        return a, b

    if spans:
        yield "secret", *around(spans[key % len(spans)][3])
    if hard is not None:
        yield "hard", *around(hard)
    if text:
        yield "plain", *around(key % len(text))


def _lowest(rows: list[tuple], windows: int) -> list[tuple]:
    """The first rows of each kind in the order of their keys."""
    out = []
    for kind in ("secret", "hard", "plain"):
        out += sorted(r for r in rows if r[0] == kind)[:windows]
    return out


def sample(batches: Iterator[pa.RecordBatch], windows: int) -> Iterator[pa.RecordBatch]:
    """Up to ``windows`` windows of each kind out of the texts of one task."""
    held: list[tuple] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for first, _, data, at in pieces(batch.column("text")):
            codes = file_codes(data, at)
            base = base_spans(data, at)
            hard = hard_places(data, at, base)
            for row, spans in enumerate(base):
                text = data[at[row] : at[row + 1]].tobytes()
                key = int(keys[first + row]) & 0x7FFFFFFFFFFF
                for kind, a, b in _windows(text, spans, hard.get(row), key):
                    values = [x for *_, s, e in spans if s < b and e > a for x in (s - a, e - a)]
                    held.append((kind, key, text[a:b].decode(), int(codes[row]), values))
            if len(held) > 8 * windows:
                held = _lowest(held, windows)
    held = _lowest(held, windows)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]
    arrays = [pa.array([x[i] for x in held], kind) for i, kind in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "window", "code", "spans"])


def training_tags(starts, ends, row, at, spans: list[list[int]]) -> np.ndarray:
    """Tags of the tokens of windows whose secrets lie at the given byte ranges."""
    tags = np.zeros(len(starts), np.int64)
    cuts = np.searchsorted(row, np.arange(len(spans) + 1))
    for r, flat in enumerate(spans):
        a, b = cuts[r], cuts[r + 1]
        s, e = starts[a:b] - at[r], ends[a:b] - at[r]
        for low, high in zip(flat[::2], flat[1::2]):
            inside = np.flatnonzero((s < high) & (e > low))
            if len(inside) and not tags[a + inside].any():
                tags[a + inside] = I
                tags[a + inside[0]] = B
    return tags


def train(docs: DataFrame, windows: int = WINDOWS) -> Field:
    """The field, from up to ``windows`` windows of each kind out of all texts."""
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key"))
    found = keyed.mapInArrow(
        released_batches(lambda batches: sample(batches, windows)),
        "kind string, key long, window string, code int, spans array<long>",
    )
    # The first of each kind, first among parts of the keys, so that no task meets the rows of all others.
    for group in (["kind", F.col("key") % PARTS], ["kind"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("key", "window"))
        found = found.withColumn("place", place).where(F.col("place") <= windows)
    rows = found.orderBy("kind", "place").collect()
    if not rows:
        return Field()
    texts = [r["window"].encode() for r in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, row, places = features(data, at, np.array([r["code"] for r in rows]))
    tags = training_tags(starts, ends, row, at, [r["spans"] for r in rows])
    keys = np.array([r["key"] for r in rows])[row]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
    return fit(blurred(places, keys), tags, edges[:-1], edges[1:]) if len(row) else Field()


def secrets_in(model: Field, data: np.ndarray, at: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """For each text, all spans ``(kind, start, end)`` in code points: by start, then kind."""
    base = base_spans(data, at)
    starts, ends, row, places = features(data, at, file_codes(data, at))
    tags = decode(scores(model, places), model.step, row)
    begins, stops = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if tags.any():
        fresh = np.r_[True, row[1:] != row[:-1]]
        first = (tags > 0) & ((tags == B) | fresh | (np.r_[O, tags[:-1]] == O))
        begins = np.flatnonzero(first)
        after = np.r_[tags[1:] != I, True] | np.r_[fresh[1:], True]
        stops = np.flatnonzero((tags > 0) & after)
    spans = [[(s, kind, e) for s, kind, e, *_ in found] for found in base]
    for a, b in zip(begins.tolist(), stops.tolist()):
        r = int(row[a])
        s, e = int(starts[a] - at[r]), int(ends[b] - at[r])
        if not any(x < e and s < y for x, _, y, *_ in base[r]):
            spans[r].append((s, 3, e))
    out = []
    for r, found in enumerate(spans):
        if found:
            text = data[at[r] : at[r + 1]]
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            found = [(KINDS[k], int(points[s]), int(points[e])) for s, k, e in sorted(found)]
        out.append(found)
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, model: Field) -> DataFrame:
    """``(doc_id, spans)`` for every row: base spans, and those of the field that overlap none of them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    @released_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans: list[list[dict]] = []
            for _, _, data, at in pieces(batch.column("text")):
                for found in secrets_in(sent.value, data, at):
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")
