"""Jaccard join on word n-grams as a blocked sparse product of the document by n-gram incidence.

Documents are rows and n-grams columns of a 0/1 matrix; the product with its transpose holds the
overlaps.  Only entries that can reach the wanted similarity are worked out:

* columns with a single entry give no product, and a document needs ``ceil(t * n)`` columns with
  two or more entries to reach similarity ``t`` with any other;
* with columns ordered from rare to frequent, two similar documents share a column among the first
  ``n - ceil(t * n) + 1`` of each (the size-derived bound), so products are taken on that block;
* an overlap cannot be larger than what either row has left from the shared column on, which must
  reach ``t / (1 + t)`` of both sizes together.

How many documents hold an n-gram comes from one exchange of key ranges (``keyed``).  Documents of
equal sets are one row of the matrix.  Within a column, rows are first multiplied with one pivot
row only; whatever is linked becomes one component, and only rows of different components that
still share a column are multiplied with each other.  So a group of many similar copies takes work
in proportion to its size, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import bytesops, keyed
from textmill.llm.graph import components
from textmill.staging import BROADCAST_ROWS, stage, stage_summary

GRAM = 5
PERCENT = 80
STAR_ROUNDS = 1
# Columns are counted by this part of their hashes.  A chance collision makes a column look shared,
# which costs a little work and changes no result.
COUNTED = np.uint64(0xFFFFFFFFFFFF0000)


def shingles(data: np.ndarray, at: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(row, hash)`` of the word n-grams of many texts, sorted; a short text is one n-gram."""
    data = bytesops.lower(data)
    starts, ends, row = bytesops.words(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = bytesops.Rolling(data).ranges(starts, ends)
    first = np.searchsorted(row, np.arange(len(at) - 1))
    count = np.diff(np.append(first, len(row)))
    n = len(word) - gram + 1
    rows, keys = [], []
    if n > 0:
        whole = row[:n] == row[gram - 1 :]
        rows.append(row[:n][whole])
        keys.append(bytesops.join_hashes([word[i : i + n] for i in range(gram)])[whole])
    for r in np.flatnonzero((count > 0) & (count < gram)):
        rows.append(np.array([r]))
        parts = word[first[r] : first[r] + count[r]]
        keys.append(bytesops.join_hashes([np.array([x]) for x in parts]) ^ np.uint64(count[r]))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[fresh], keys[fresh]


def _ask(batches: Iterator[pa.RecordBatch], gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    low = ~COUNTED

    def add(state: list, batch: pa.RecordBatch) -> None:
        # The count of a piece stands in the bits that the key leaves free (a larger one in parts).
        for _, _, data, at in bytesops.pieces(batch.column("text")):
            keys, counts = np.unique(shingles(data, at, gram)[1] & COUNTED, return_counts=True)
            while len(keys):
                now = np.minimum(counts, int(low)).astype(np.uint64)
                state.append(keys | now)
                counts = counts - now.astype(np.int64)
                keys, counts = keys[counts > 0], counts[counts > 0]

    def end(split: int, state: list) -> pa.RecordBatch:
        both = np.concatenate(state) if state else np.zeros(0, np.uint64)
        state.clear()
        both.sort()
        cuts = keyed.range_cuts(both, bits)
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):  # range by range, which keeps the arrays small
            own = both[cuts[b] : cuts[b + 1]]
            keys = own & COUNTED
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = np.minimum(np.add.reduceat(own & low, starts), 0xFFFFFFFF).astype(np.uint32)
            rows.append((int(b), keyed.pack_keys(keys[starts]), [keyed.pack(sums)]))
        return keyed.question_rows(split, rows)

    yield from keyed.per_split(batches, list, add, end)


def _rows(docs: pa.Table, replies: pa.Table, gram: int, percent: int) -> Iterator[tuple]:
    """Per document: size, hash of the set, and the shared n-grams from rare to frequent."""
    pieces = bytesops.pieces(docs["text"])
    known = keyed.distinct([np.unique(shingles(data, at, gram)[1] & COUNTED) for _, _, data, at in pieces])[0]
    frequency = keyed.aligned(replies, np.uint32)
    ids = docs["doc_id"].to_pylist()
    # The n-grams are worked out again rather than held for all texts of the split.
    for first, last, data, at in bytesops.pieces(docs["text"]):
        rows, keys = shingles(data, at, gram)
        n_rows = last - first
        often = frequency[np.searchsorted(known, keys & COUNTED)]
        cuts = np.searchsorted(rows, np.arange(n_rows + 1))
        checks = np.zeros(len(keys) + 1, dtype=np.uint64)
        np.cumsum(bytesops.mix(keys ^ np.uint64(0x5851F42D4C957F2D)), out=checks[1:])
        sums = np.zeros(len(keys) + 1, dtype=np.uint64)
        np.cumsum(keys, out=sums[1:])
        shared_before = np.zeros(len(keys) + 1, dtype=np.int64)
        np.cumsum(often > 1, out=shared_before[1:])
        h1 = (sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64).tolist()
        h2 = (checks[cuts[1:]] - checks[cuts[:-1]]).view(np.int64).tolist()
        for r in range(n_rows):
            a, b = cuts[r], cuts[r + 1]
            n, shared = int(b - a), int(shared_before[b] - shared_before[a])
            need = -(-percent * n // 100)
            list_ = None
            if n and shared >= need:
                k, f = keys[a:b], often[a:b]
                k, f = k[f > 1], f[f > 1]
                list_ = k[np.lexsort((k, f))].view(np.int64)
            # The product's block: the first n - need + 1 columns, less those without a second entry.
            yield ids[first + r], n, h1[r], h2[r], max(0, shared - need + 1), list_


def incidence(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n, h1, h2, block, grams`` (null if it can have no partner)."""
    bits = keyed.bucket_bits(docs)
    placed = keyed.by_split(docs)
    questions = placed.mapInArrow(bytesops.released_batches(lambda batches: _ask(batches, gram, bits)), keyed.ASKED)
    replies = keyed.answers(questions, [np.uint32], lambda g: np.minimum(g.total(0), 0xFFFFFFFF).astype(np.uint32)[g.of])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = list(zip(*_rows(left, right, gram, percent))) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        return pa.table(
            [pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["doc_id", "n", "h1", "h2", "block", "grams"]
        )

    return (
        placed.groupBy(keyed.SPLIT)
        .cogroup(replies.groupBy(keyed.SPLIT))
        .applyInArrow(bytesops.released_pair(run), "doc_id long, n long, h1 long, h2 long, block int, grams array<long>")
    )


def _can_reach(left: tuple[str, str], right: tuple[str, str], percent: int) -> Column:
    """Whether rows ``(size, columns left)`` can overlap enough."""
    return (100 + percent) * F.least(left[1], right[1]) >= percent * (F.col(left[0]) + F.col(right[0]))


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose overlap reaches the similarity.

    ``pairs`` is a written table; if its counted size is small, only the rows it names are moved.
    """
    small = pairs.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)
    named = rows.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    left = named.join(sent(pairs), "a")
    named = rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    right = named.join(sent(pairs.select("b").distinct()), "b", "left_semi")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return (
        left.join(right, "b")
        .select("a", "b", "na", "nb", overlap.alias("o"))
        .where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o")))
        .select("a", "b")
    )


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components of linked rows."""
    of_a = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    edges = links.join(of_a, "a").join(of_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = stage(components(edges), "roots").select(F.col("id").alias("component"), F.col("component").alias("_root"))
    joined = labels.join(roots, "component", "left")
    return stage(joined.select("id", F.coalesce("_root", "component").alias("component")), "labels")


def linked_rows(rows: DataFrame, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """``(id, component)`` of distinct rows ``(id, n, block, grams)`` of the incidence matrix."""
    m = F.size("grams")
    entries = rows.select("id", "n", m.alias("m"), F.posexplode(F.slice("grams", 1, F.col("block"))).alias("i", "gram"))
    entries = entries.select("gram", "id", "n", (F.col("n") - F.col("m")).alias("own"), (F.col("m") - F.col("i")).alias("ahead"))
    often = stage(entries.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "columns")
    block = stage(entries.join(often, "gram"), "block")
    labels = stage(rows.select("id", F.col("id").alias("component")).distinct(), "labels")
    for step in range(star_rounds + 1):
        named = block.join(labels, "id")
        # Copies have n-grams of their own where they differ; the row with fewest is likely the original.
        rank = F.struct(
            *([F.col("own")] if step == 0 else []), F.xxhash64("id", F.lit(step)).alias("r"), "id", "n", "ahead", "component"
        )
        open_columns = named.groupBy("gram").agg(
            F.min(rank).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi")
        )
        pivots = stage(
            open_columns.where("lo <> hi").select(
                "gram",
                F.col("p.id").alias("b"),
                F.col("p.n").alias("nb"),
                F.col("p.ahead").alias("ab"),
                F.col("p.component").alias("cb"),
            ),
            "pivots",
        )
        if pivots.isEmpty():
            break
        near = _can_reach(("n", "ahead"), ("nb", "ab"), percent)
        if step < star_rounds:
            met = named.join(pivots, "gram").where(F.col("component") != F.col("cb")).where(near)
            shared = met.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("c"))
            pairs = shared.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        else:  # every pair of rows of different components that still share a column
            left = named.join(pivots.select("gram"), "gram").select("gram", F.col("id").alias("a"), "n", "ahead", "component")
            right = left.toDF("gram", "b", "nb", "ab", "cb")
            pairs = left.join(right, "gram").where("component < cb").where(near).select("a", "b").distinct()
        links = stage(_verified(stage(pairs, "pairs"), rows, percent), "links")
        if not links.isEmpty():
            labels = _merged(labels, links)
    return labels


def ngram_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Null, empty and blank texts have no n-grams and are alone.  Equal texts are linked.  Rows that
    repeat an id are the same document.  Other columns are not read, so their names do not matter.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    matrix = stage(incidence(named, gram, percent), "incidence")
    partners = matrix.where("grams is not null")
    classes = stage_summary(partners.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id")), "classes")
    firsts = classes.select("n", "h1", "h2", F.col("id").alias("doc_id"))
    rows = stage(
        partners.join(firsts, ["n", "h1", "h2", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "block", "grams"),
        "rows",
    )
    labels = stage(classes.join(linked_rows(rows, percent), "id").select("n", "h1", "h2", "component"), "components")
    joined = matrix.select("doc_id", "n", "h1", "h2").join(labels, ["n", "h1", "h2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
