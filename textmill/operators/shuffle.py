"""Global random order of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.keys import bucket_of, stable_key
from textmill.operators.identity import with_row_id
from textmill.operators.position import with_hash_position


def shuffle(
    df: DataFrame,
    n_files: int,
    seed: int = 0,
    key: str | Sequence[str] | None = None,
    emit_pos: bool = False,
    stable: bool = True,
) -> DataFrame:
    """Put all rows into one random order, in ``n_files`` partitions to be written as files.

    The files read one after the other have the order; ``emit_pos`` also adds it as
    ``shuffle_pos``.  The stable order is a function of ``seed`` and the row's ``key`` (unique
    columns; without it the whole row counts).  Its buckets are ranges of a uniform hash, so
    they are even and there is exactly one exchange of the data.  ``stable=False`` sorts by
    ``rand(seed)`` instead, which depends on the input's layout.
    """
    if not stable:
        if emit_pos:
            raise ValueError("positions need the stable order")
        drawn = df.withColumn("_key", F.rand(int(seed)))
        return drawn.repartitionByRange(n_files, "_key").sortWithinPartitions("_key").drop("_key")
    if key is None:
        ids, rows = ["_id"], with_row_id(df, name="_id")
    else:
        ids, rows = ([key] if isinstance(key, str) else list(key)), df
    drawn = stable_key(seed, *ids)
    if emit_pos:
        placed = with_hash_position(rows, drawn, ids, n_files, name="shuffle_pos")
        return placed.select(*df.columns, "shuffle_pos")
    return (
        rows.repartitionById(n_files, bucket_of(drawn, n_files))
        .withColumn("_key", drawn)
        .sortWithinPartitions("_key", *ids)
        .select(*df.columns)
    )


def shuffle_epochs(
    samples: DataFrame, seed: int, epochs: Sequence[int], ids: Sequence[str], n: int | None = None
) -> DataFrame:
    """The order of the samples in each of several epochs: ``(epoch, pos, ids...)``.

    Only identities are ordered; the samples themselves stay where they are and are joined
    by id when a run reads its epoch.
    """
    per_epoch = samples.select(*ids).withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    keyed = per_epoch.withColumn("_key", stable_key(seed, "epoch", *ids))
    placed = with_hash_position(keyed, "_key", ids, n, group=["epoch"], max_groups=len(epochs))
    return placed.select("epoch", "pos", *ids)


def epoch_samples(order: DataFrame, samples: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The samples that a kept epoch order names, with their ``pos`` and ``copy``.

    ``ids`` identify a sample.  A sample that an epoch repeats very often is a hot key on the
    order's side only; adaptive execution splits such a partition
    (``spark.sql.adaptive.skewJoin.enabled``, on by default).
    """
    return order.join(samples, list(ids))
