"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector to signs of random projections and sorts the vectors by the
concatenated signs, so that near vectors lie close together.  Every vector is compared, in double
precision, with a bounded window of its neighbours in that order, and pairs that reach the wanted
cosine are united over all passes.  Other projections make other orders, so what one pass parts
another brings together.

The order is cut into blocks of as many rows as a window; a block sees the one before it, so each
vector meets at least a window of predecessors and a task holds two blocks.  Bitwise equal vectors
are one vector with a count, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.graph import components
from textmill.operators.position import with_position
from textmill.staging import stage

PASSES = 8
WINDOW = 1024
BITS = 62
PERCENT = 95


def planes(step: int, width: int, bits: int = BITS) -> np.ndarray:
    """Random projections of a pass; fixed by its number."""
    return np.random.default_rng([20240611, step]).standard_normal((width, bits))


def unit_rows(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = np.asarray(lists.flatten().cast(pa.float64())).reshape(len(lists), width)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Usable vectors ``(id, width, embedding, copies)``, equal ones once under their smallest id.

    Null or empty vectors, zero vectors and those with null or non-finite components are left out.
    """
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & sound & F.exists(e, lambda x: x != 0)
    )
    return usable.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))


def _keys(batches, width: int, passes: int):
    sheets = np.concatenate([planes(p, width) for p in range(passes)], axis=1)
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            signs = unit_rows(part.column("embedding"), width) @ sheets > 0
            ids = np.asarray(part.column("id"))
            for p in range(passes):
                key = signs[:, p * BITS : (p + 1) * BITS] @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), p, dtype=np.int32)), pa.array(key), pa.array(ids)], names=["pass", "key", "id"]
                )


def _compare(table: pa.Table, width: int, cosine: float) -> pa.Table:
    """Pairs of the rows of a block with earlier rows of it and of the block before."""
    table = table.sort_by([("pos", "ascending")])
    ids, owned = np.asarray(table["id"]), np.asarray(table["own"])
    rows = unit_rows(table["embedding"], width)
    first = int(np.flatnonzero(owned)[0]) if owned.any() else len(ids)
    left, right = [], []
    for at in range(first, len(ids), 256):
        end = min(len(ids), at + 256)
        near = rows[at:end] @ rows[:end].T
        i, j = np.nonzero(near >= cosine)
        keep = j < i + at
        left.append(ids[i[keep] + at])
        right.append(ids[j[keep]])
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def near_pairs(vectors: DataFrame, width: int, percent: int = PERCENT, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """Distinct pairs ``(a, b)`` found among vectors ``(id, embedding)`` of ``width`` components."""
    keys = vectors.select("id", "embedding").mapInArrow(lambda b: _keys(b, width, passes), "pass int, key long, id long")
    # Vectors with the same signs come in another order in each pass, so that each meets others.
    tied = keys.withColumn("tie", F.xxhash64("id", "pass"))
    placed = with_position(tied, ["pass", "key", "tie", "id"]).select(
        "id", "pass", "pos", F.expr(f"pos div {window}").alias("block")
    )
    # A block's rows, and again for the block after it, unless that belongs to another pass alone.
    seen = placed.select(
        "id", "pass", "pos", F.explode(F.array(F.struct("block", F.lit(True).alias("own")), F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own")))).alias("x")
    ).select("id", "pass", "pos", "x.block", "x.own")
    rows = seen.join(vectors.select("id", "embedding"), "id")
    cosine = percent / 100
    pairs = rows.groupBy("pass", "block").applyInArrow(lambda t: _compare(t, width, cosine), "a long, b long")
    return pairs.distinct()


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    embedding: str = "embedding",
    percent: int = PERCENT,
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    ``n_links`` counts the other vectors linked directly (equal vectors each), as found; a vector
    that cannot be compared (null, empty, zero, or with null or non-finite components) is alone.
    Vectors of different widths are not compared.  A null id is alone and keeps a null component.
    Rows that share an id are the same vector.  Other columns are not read.
    """
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    distinct = stage(distinct_vectors(named), "vectors")
    widths = [r["w"] for r in distinct.groupBy(F.size("embedding").alias("w")).count().orderBy("w").collect()]
    pairs = None
    for width in widths:  # one, unless the table mixes models
        found = near_pairs(distinct.where(F.size("embedding") == width), width, percent, passes, window)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return named.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    pairs = stage(pairs, "pairs")
    roots = stage(components(pairs), "roots")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = distinct.select(F.col("id").alias("b"), "copies")
    links = both.join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("near"))
    classes = stage(
        distinct.join(links, "id", "left")
        .join(roots, "id", "left")
        .select(
            F.col("embedding").alias("_e"),
            (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "classes",
    )
    joined = named.join(classes, F.col("embedding") == F.col("_e"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
