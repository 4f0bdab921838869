"""Text quality by logistic regression over hashed word n-grams, trained by FTRL-proximal.

Tokens are runs of letters and digits, and runs of other signs.  Three kinds of n-grams are hashed
into one table: lower-case tokens, pairs of tokens, and triples of token shapes (small, capital,
all capitals, digits, same as before, the first sign of a run, a line's end).  A text is the unit
vector of its damped counts, and its score the sigmoid of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops
from textmill.llm.labelled import labelled_sample
from textmill.llm.linear import Ftrl, sigmoid

DIMENSIONS = 1 << 18
SAMPLE_ROWS = 6000
EPOCHS = 4

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_KIND[0x0A] = 3
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def features(data: np.ndarray, at: np.ndarray, size: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``(row, index, value)`` of many texts, sorted by row and index."""
    n = len(data)
    kind = _KIND[data]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    fresh[at[:-1][at[:-1] < n]] = True
    bounds = np.flatnonzero(fresh)
    ends = np.append(bounds[1:], n)
    solid = kind[bounds] > 0
    start, end = bounds[solid], ends[solid]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    token_kind = kind[start]
    row = np.searchsorted(at, start, "right") - 1
    word = bytesops.Rolling(bytesops.lower(data)).ranges(start, end)
    upper = np.zeros(n + 1, dtype=np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    digit = np.zeros(n + 1, dtype=np.int64)
    np.cumsum((data >= 48) & (data <= 57), out=digit[1:])
    caps = upper[end] - upper[start]
    length = end - start
    shape = np.zeros(len(start), dtype=np.uint64)
    shape[caps > 0] = 1
    shape[(caps > 1) & (2 * caps >= length)] = 2
    shape[digit[end] > digit[start]] = 3
    signs = token_kind == 2
    shape[signs] = 16 + data[start[signs]].astype(np.uint64)
    shape[signs & (length > 1)] += np.uint64(512)
    shape[token_kind == 3] = 5
    same = np.zeros(len(start), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1]) & (token_kind[1:] == 1)
    shape[same] = 4
    pair = np.where(same, np.uint64(7), word)
    second = row[1:] == row[:-1]
    third = row[2:] == row[:-2]
    one = np.uint64(1)
    kinds = [
        (row, word),
        (row[1:][second], bytesops.join_hashes([word[:-1], pair[1:]])[second]),
        (row[2:][third], bytesops.join_hashes([shape[:-2] + one, shape[1:-1] + one, shape[2:] + one])[third]),
    ]
    keys = np.concatenate([r * size + (h % np.uint64(size)).astype(np.int64) for r, h in kinds])
    keys, counts = np.unique(keys, return_counts=True)
    row, index = keys // size, keys % size
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(at) - 1))
    return row, index, value / norm[row]


def _vectors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for first, last, data, at in bytesops.pieces(column):
            row, index, value = features(data, at, size)
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    batch.column("y").slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(value, pa.float32())),
                ],
                names=["doc_id", "y", "index", "value"],
            )


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
    size: int = DIMENSIONS,
    epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights and a last intercept, learnt from at most ``rows`` labelled documents.

    Texts become sparse vectors in the tasks; only vectors of at most ``size`` entries come to the
    driver, in an order given by the ids, so a repeated run gives the same weights.  Without
    labelled rows all weights are 0.
    """
    sample = labelled_sample(docs, labels, label, rows)
    vectors = sample.select("doc_id", "y", "text").mapInArrow(
        lambda batches: _vectors(batches, size), "doc_id long, y int, index array<int>, value array<float>"
    )
    found = vectors.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    model = Ftrl(size + 1)
    if not found.num_rows:
        return model.weights().astype(np.float32)
    labels_of = np.asarray(found["y"])
    lists = found["index"].chunk(0)
    cuts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    index, value = np.asarray(lists.flatten()), np.asarray(found["value"].chunk(0).flatten())
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(labels_of)):
            own = slice(cuts[i], cuts[i + 1])
            # The last weight is the intercept, whose value is 1.
            model.learn(np.append(index[own].astype(np.int64), size), np.append(value[own], 1.0), int(labels_of[i]))
    return model.weights().astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``: the probability of label 1 for every row of ``docs``.

    Null and empty texts get the intercept's score.  Rows may repeat; other columns are not read.
    ``weights`` are of fixed size and travel with the function.
    """
    size = len(weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for first, last, data, at in bytesops.pieces(column):
                row, index, value = features(data, at, size)
                total = np.bincount(row, weights[index] * value, minlength=last - first) + weights[size]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(sigmoid(total), pa.float64())],
                    names=["doc_id", "score"],
                )

    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, "doc_id long, score double")
