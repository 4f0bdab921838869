"""Reading document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.position import with_position
from textmill.sources.files import is_dir, qualified, scanned_files

TOP_N_KEYS = 1000
SAMPLE_KEYS = 20_000


def read_corpus(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    recurse: bool = False,
    subset: str | None = None,
    subset_col: str = "subset",
) -> DataFrame:
    """Lazy scan of files or directories; a path given twice is read twice.

    A directory stands for its direct files, or with ``recurse`` for all files below.
    ``subset`` picks one inner dataset of a partitioned root (the others are not listed).
    Name a ``schema`` for JSON: inferring one reads everything once more.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if not listed:
        raise ValueError("no input files")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if recurse:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.load(listed)
    return df if subset is None else df.where(F.col(subset_col) == subset).drop(subset_col)


def direct_files(spark: SparkSession, path: str) -> list[str]:
    """A directory's own files (no sub-directories); a file stands for itself."""
    if not is_dir(spark, path):
        return [path]
    # Spark lists in parallel and leaves hidden files out; only names are asked for, no content.
    found = scanned_files(spark.read.format("binaryFile").load(path))
    own = qualified(spark, path).rstrip("/")
    parts = [p.rsplit("/", 1) for p, _ in found]
    return sorted(f"{path.rstrip('/')}/{name}" for folder, name in parts if folder == own)


def read_list(
    spark: SparkSession, files: str, fmt: str, root: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """Scan by format name and a comma-separated list of files, relative to ``root`` if given."""
    names = [f.strip() for f in files.split(",") if f.strip()]
    prefix = f"{root.rstrip('/')}/" if root else ""
    return read_corpus(spark, [prefix + n for n in names], fmt, schema)


def select_text(df: DataFrame, key: str = "text") -> DataFrame:
    """Only the column to be processed, as ``text``; the scan reads no other."""
    return df.select(F.col(key).alias("text"))


def select_keys(df: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """One text frame per JSON key."""
    return {key: select_text(df, key) for key in keys}


def decompress_json(
    spark: SparkSession, paths: str | Sequence[str], out: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Gzipped JSON lines to plain JSON lines.

    A gzip file cannot be split, so each is read by one task; the rows are rebalanced
    before they are written.
    """
    df = read_corpus(spark, paths, "json", schema).hint("rebalance")
    df.write.mode("errorifexists").option("compression", "none").json(out)
    return spark.read.schema(df.schema).json(out)


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Exactly the first ``n`` rows in the total order given by the columns ``order``.

    The place of the last row is found on the order columns alone; the rows are then filtered
    by it, which for a single column is a range predicate that the scan can use.
    """
    last = _nth_key(df.select(*order), n, order) if n > 0 else None
    if last is None:
        return df if n > 0 else df.where(F.lit(False))
    return _up_to(df, last, order)


def _up_to(df: DataFrame, last: Row, order: Sequence[str]) -> DataFrame:
    """The rows whose order columns are not beyond ``last``; nulls come first."""
    if len(order) == 1:
        column = F.col(order[0])
        if last[0] is None:
            return df.where(column.isNull())
        up_to = column <= F.lit(last[0])
        # The scan can tell from its statistics whether there are any nulls.
        return df.where(up_to if df.where(column.isNull()).isEmpty() else column.isNull() | up_to)
    types = {f.name: f.dataType for f in df.schema.fields}
    bound = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, last)])
    return df.where(F.struct(*order) <= bound)


def _nth_key(keys: DataFrame, n: int, order: Sequence[str]) -> Row | None:
    """Order columns of the ``n``-th row; nothing if there are fewer rows.

    A small ``n`` is a top-n.  For a larger one every task would send ``n`` keys to a single
    task, so the keys up to a bound a little beyond the ``n``-th are numbered by range partitions.
    """
    if n <= TOP_N_KEYS:
        return _last_of_first(keys, n, order)
    near = _near_first(keys, n, order)
    return with_position(near, order, name="_pos").where(F.col("_pos") == n - 1).select(*order).first()


def _last_of_first(keys: DataFrame, n: int, order: Sequence[str]) -> Row | None:
    first = keys.orderBy(*order).limit(n)
    found = first.agg(F.count("*").alias("rows"), F.max(F.struct(*order)).alias("last")).first()
    return found["last"] if found["rows"] == n else None


def _near_first(keys: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Keys that hold the first ``n``, fewer than twice as many unless a key beyond them repeats.

    About ``SAMPLE_KEYS`` keys are drawn from all; the one that lies a little beyond the place where the
    ``n``-th must be bounds them.  What is below is counted, so a bad draw costs a pass and no row, and
    is drawn from anew while it is too much: each pass keeps a small part of the one before, and reads
    no more than the bound lets it.
    """
    near, rows, draws = keys, keys.count(), 0
    while rows >= 2 * n:
        share = min(1.0, SAMPLE_KEYS / rows)
        place = n * share
        place = int(place + 4 * place**0.5) + 4
        bound = _last_of_first(near.sample(share, seed=draws), place << draws, order)
        if bound is None:
            break
        below = _up_to(near, bound, order)
        found = below.count()
        draws += 1
        if found >= n:
            if found == rows:
                break
            near, rows, draws = below, found, 0
    return near
