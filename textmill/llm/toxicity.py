"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary texts, one on windows of toxic
texts, words and word pairs that are significantly more frequent there (log-likelihood ratio of
document counts).  Every word of a text is a window: it is set between copies of a fixed carrier of
ordinary text (so that a frame's fixed cost is paid once), compressed with either dictionary, and
the difference of the two lengths says how much better the toxic dictionary knows it.  So that
ordinary words cancel out, the ordinary dictionary is also held against itself followed by the
strongest marks, and, for passages of several words, against itself followed by the toxic one.
Thresholds on these differences are
calibrated by a logistic fit on labelled documents that had no part in the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops
from textmill.llm.labelled import labelled_sample
from textmill.llm.linear import fit_logistic, sigmoid

SAMPLE_ROWS = 12000
ORDINARY_BYTES = 112640
TOXIC_BYTES = ORDINARY_BYTES
MARK_BYTES = 600  # of the strongest marks
TOXIC_WINDOWS = 20000  # distinct words and pairs that the toxic dictionary is trained on
#: Least log-likelihood ratio and number of toxic texts of a word, and of a pair (there are more of them).
MARKING = {1: (12.0, 2), 2: (20.0, 3)}
ORDINARY_WORDS = 30000
TRAINING_WINDOWS = 200000
LEVEL = 19
PASSAGE_LEVEL = 3
PASSAGE, STEP = 16, 12  # words of a passage, and from one to the next
TOXIC_GRAM, MARK_GRAM = 5, 4  # bytes that a word must share with a dictionary to be compressed with it
LEAD = 1  # least difference of a word that gives reason to look at its passages
SPAN = 24  # differences are counted from -SPAN to SPAN
CACHED_WORDS = 1 << 17
WORD_BYTES = 256  # longer words are cut into windows of this length


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    carrier: bytes
    weights: list[float]
    marked: bytes = b""  # the ordinary dictionary followed by the strongest marks


def _compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    shape = zstandard.ZstdCompressionParameters.from_level(
        level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=shape
    )


WIDTH = 2 * SPAN + 1


def _clipped(difference: int) -> int:
    return max(-SPAN, min(SPAN, difference)) + SPAN


def _grams(text: bytes, n: int) -> frozenset[bytes]:
    return frozenset(text[i : i + n] for i in range(len(text) - n + 1))


def _shares(word: bytes, grams: frozenset[bytes], n: int) -> bool:
    """Whether a word, with the spaces around it, has one of the strings; a shorter one counts as having it."""
    return len(word) < n or not grams.isdisjoint([word[i : i + n] for i in range(len(word) - n + 1)])


class Distances(dict):
    """Differences of the compressed lengths of a word's window, as one number.

    It counts the difference to the toxic dictionary in rows of ``WIDTH``, that to the
    ordinary one followed by marks in columns.  Words are kept in two generations of bounded size, so that frequent ones stay known.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, carrier: bytes, marked: bytes = b""):
        super().__init__()
        self.plain, self.marked = _compressor(ordinary).compress, _compressor(toxic).compress
        self.both = _compressor(marked or ordinary + toxic).compress
        self.carrier = carrier
        self.older: dict[bytes, int] = {}
        self.toxic_grams = _grams(toxic, TOXIC_GRAM)
        both = marked or ordinary + toxic
        self.mark_grams = _grams(both[len(ordinary) :] if both.startswith(ordinary) else both, MARK_GRAM)

    def __missing__(self, word: bytes) -> int:
        value = self.older.get(word)
        if value is None:
            value = self._measured(b" " + word + b" ")
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value

    def _measured(self, word: bytes) -> int:
        """A dictionary that shares no string of some bytes with the word cannot know it better: no difference."""
        toxic, marks = _shares(word, self.toxic_grams, TOXIC_GRAM), _shares(word, self.mark_grams, MARK_GRAM)
        if not toxic and not marks:
            return SPAN * WIDTH + SPAN
        window = self.carrier + word + self.carrier
        plain = len(self.plain(window))
        first = _clipped(plain - len(self.marked(window))) if toxic else SPAN
        return first * WIDTH + (_clipped(plain - len(self.both(window))) if marks else SPAN)

    def found(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def histogram(self, text: bytes) -> np.ndarray:
        """Counts of the differences over a whole text."""
        return sum((_table(self.found(words)) for words in _pieces(text)), np.zeros((WIDTH, WIDTH), dtype=np.int64))


def _table(found: np.ndarray) -> np.ndarray:
    return np.bincount(found, minlength=WIDTH * WIDTH).reshape(WIDTH, WIDTH)


def _leads(found: np.ndarray) -> np.ndarray:
    """The words that either dictionary knows better than the ordinary one does."""
    return np.maximum(found // WIDTH, found % WIDTH) - SPAN >= LEAD


class Passages:
    """Differences of the compressed lengths of passages, which overlap by ``PASSAGE - STEP`` words.

    A passage without a leading word is not compressed: it counts as no difference.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain = _compressor(ordinary, PASSAGE_LEVEL).compress
        self.marked = _compressor(ordinary + toxic, PASSAGE_LEVEL).compress

    def counts(self, words: list[bytes], leads: np.ndarray) -> np.ndarray:
        starts = np.arange(0, max(1, len(words) - PASSAGE + STEP) if words else 0, STEP)
        before = np.concatenate([[0], np.cumsum(leads)])
        kept = starts[before[np.minimum(starts + PASSAGE, len(words))] > before[starts]]
        counts = np.zeros(WIDTH, dtype=np.int64)
        counts[SPAN] = len(starts) - len(kept)
        for at in kept.tolist():
            window = b" " + b" ".join(words[at : at + PASSAGE]) + b" "
            counts[_clipped(len(self.plain(window)) - len(self.marked(window)))] += 1
        return counts


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that end at white space."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + (1 << 20))
        while end < n and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].lower().split()
        if any(len(w) > WORD_BYTES for w in words):
            words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
        yield words
        at = end


def summary(counts: np.ndarray) -> np.ndarray:
    """Features of a text from differences of one kind: the four largest, and how many pass each threshold."""
    above = counts[::-1].cumsum()[::-1]
    n = max(1, int(above[0]))
    top = [float(np.flatnonzero(above >= k)[-1] - SPAN) if above[0] >= k else 0.0 for k in (1, 2, 3, 4)]
    passed = [np.log1p(above[SPAN + k]) for k in range(3, 13)]
    return np.array([*top, *passed, np.log1p(above[0]), above[SPAN + 4] / n, above[SPAN + 6] / n])


N_FEATURES = 3 * 17


class Features:
    """Features of texts: of their words, then of their passages."""

    def __init__(self, model: ToxicityModel):
        self.distances = Distances(model.ordinary, model.toxic, model.carrier, model.marked)
        self.passages = Passages(model.ordinary, model.toxic)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        rows = np.zeros((len(texts), N_FEATURES))
        for row, text in zip(rows, texts):
            words, passages = np.zeros((WIDTH, WIDTH), dtype=np.int64), np.zeros(WIDTH, dtype=np.int64)
            for piece in _pieces(text.as_py().encode() if text.is_valid else b""):
                found = self.distances.found(piece)
                words = words + _table(found)
                passages = passages + self.passages.counts(piece, _leads(found))
            row[:] = np.concatenate([summary(words.sum(1)), summary(words.sum(0)), summary(passages)])
        return rows


def _summaries(model: ToxicityModel, out, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features(model)
    for batch in batches:
        yield out(batch, features(batch.column("text")))


def _marking(windows: DataFrame, toxic: int, plain: int, least: float, texts: int) -> DataFrame:
    """Windows ``(doc_id, y, word)`` that mark toxic documents as ``(word, ratio)``.

    ``ratio`` is the log-likelihood ratio of the numbers of toxic and ordinary documents with the
    window, out of ``toxic`` and ``plain``; those below ``least`` or in fewer toxic ``texts`` are left out.
    """
    counts = (
        windows.groupBy("word", "doc_id")
        .agg(F.max("y").alias("y"))
        .groupBy("word")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("p"))
        .where(F.col("t") >= texts)
    )
    share = toxic / (toxic + plain)
    ratio = F.lit(0.0)
    for seen, total, part in (("t", toxic, share), ("p", plain, 1 - share)):
        n = F.col("t") + F.col("p")
        for observed, expected in ((F.col(seen), n * part), (total - F.col(seen), total - n * part)):
            ratio = ratio + F.when(observed > 0, 2 * observed * F.log(observed / expected)).otherwise(0.0)
    return counts.where(F.col("t") * plain > F.col("p") * toxic).select("word", ratio.alias("ratio")).where(F.col("ratio") >= least)


def _dictionary(windows: list[bytes], most: int) -> bytes:
    try:
        return zstandard.train_dictionary(min(most, max(256, sum(map(len, windows)) // 8)), windows).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: a dictionary of the text itself
        return b"".join(windows)[-most:]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Dictionaries and thresholds from at most ``rows`` labelled documents.

    Two thirds of the sample give the dictionaries, the rest the thresholds.  What reaches the
    driver is bounded by parameters: the most frequent ordinary words with their counts, the words and
    pairs that mark toxic documents, and one feature row per document for the fit.  Without labels every
    document scores 0.
    """
    sample = labelled_sample(docs, labels, label, rows)
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.filter(F.split(lowered, "[\\x20\\x09-\\x0D]+"), lambda w: (w != "") & (F.octet_length(w) <= WORD_BYTES))
    texts = sample.where("fold < 2").select("doc_id", "y", split.alias("words"))
    words = texts.select("doc_id", "y", F.explode("words").alias("word"))
    ordinary = (
        words.where("y = 0").groupBy("word").agg(F.count("*").alias("plain")).orderBy(F.desc("plain"), "word").limit(ORDINARY_WORDS).collect()
    )
    total = max(1, sum(r["plain"] for r in ordinary))
    windows = [
        b" " + r["word"].encode() + b" "
        for r in ordinary
        for _ in range(-(-r["plain"] * TRAINING_WINDOWS // total))
    ]
    np.random.default_rng(3).shuffle(windows)
    plain = _dictionary(windows, ORDINARY_BYTES) or b" "
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count_distinct("doc_id").alias("n")).collect()}
    marks = []
    if len(sizes) == 2:
        pairs = F.expr("array_distinct(transform(words, (w, i) -> concat(w, ' ', get(words, i + 1))))")
        pairs = texts.select("doc_id", "y", F.explode(pairs).alias("word")).where("word is not null")
        found = [_marking(x, sizes[1], sizes[0], *MARKING[k]) for k, x in ((1, words), (2, pairs))]
        marks = found[0].unionByName(found[1]).orderBy(F.desc("ratio"), "word").limit(TOXIC_WINDOWS).collect()
    total = sum(r["ratio"] for r in marks)
    windows = [
        b" " + r["word"].encode() + b" " for r in marks for _ in range(int(np.ceil(r["ratio"] * TRAINING_WINDOWS / total)))
    ]
    np.random.default_rng(4).shuffle(windows)
    toxic = _dictionary(windows, TOXIC_BYTES) or plain
    carrier = b"".join(r["word"].encode() for r in ordinary if len(r["word"]) >= 4 and r["word"].isalpha())[:8]
    strongest, size = [], 0
    for word in (r["word"].encode() + b" " for r in marks):
        size += len(word)
        if size > MARK_BYTES:
            break
        strongest.append(word)
    model = ToxicityModel(plain, toxic, carrier or b"text", [], plain + b"".join(reversed(strongest)))

    def labelled(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1) * N_FEATURES, pa.int32()), pa.array(rows.ravel(), pa.float64())
        )
        return pa.RecordBatch.from_arrays([batch.column("y"), lists], names=["y", "x"])

    fitted = (
        sample.where("fold = 2")
        .select("text", "y")
        .mapInArrow(bytesops.released_batches(lambda batches: _summaries(model, labelled, batches)), "y int, x array<double>")
        .toArrow()
    )
    if fitted.num_rows:
        y = np.asarray(fitted["y"].to_pylist(), dtype=float)
        x = np.asarray(fitted["x"].to_pylist(), dtype=float)
        order = np.lexsort([*x.T, y])  # the fit does not depend on the order of the tasks
        model.weights = fit_logistic(x[order], y[order]).tolist()
    return model


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Texts are scored where they are read, so nothing is shuffled.
    """
    weights = np.asarray(model.weights)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model)
        for batch in batches:
            yield batch.filter(pa.array(_probability(features(batch.column(place)), weights) < threshold))

    return docs.mapInArrow(bytesops.released_batches(run), docs.schema)


def _probability(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return sigmoid(rows @ weights[:-1] + weights[-1]) if len(weights) else np.zeros(len(rows))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``: the probability that a text is toxic, for every row of ``docs``.

    Null and empty texts have no windows and get the score of no evidence.  Rows may repeat; other
    columns are not read.  The model is of fixed size and travels with the function.
    """
    weights = np.asarray(model.weights)

    def scored(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        value = _probability(rows, weights)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64())], names=["doc_id", "score"])

    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(
        bytesops.released_batches(lambda batches: _summaries(model, scored, batches)), "doc_id long, score double"
    )
