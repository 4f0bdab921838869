"""Row positions and running totals without a one-task window.

Four ways to number rows, by what is known of the order:

* the scan order of Parquet files: counts per file plus the row index, no shuffle;
* the line order of JSON files: counts per fixed range of bytes, no shuffle;
* the order of a stable hash key: equal hash buckets, one shuffle, no sampling pass;
* any other total order: range partitions written once, then numbered.

All of them add a per-partition offset, taken from a small table of counts, to a local
index.  Windows only ever run inside one bounded partition or over that small table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.chunks import int_div
from textmill.functions.keys import bucket_of
from textmill.session import shuffle_width, small_table
from textmill.sources.files import decoded_path, scanned_files
from textmill.sources.lines import RANGE_BYTES, RangedLines, can_open
from textmill.staging import BROADCAST_ROWS, stage, stage_summary

# Upper limits of the summary tables that are handled as a whole.
MAX_SUMMARY_ROWS = 1 << 20
BLOCK_ROWS = 1024

_SLOT_BITS = 33  # monotonically_increasing_id: partition id above, row index below
_ROW_BITS = (1 << _SLOT_BITS) - 1


def before(value: Column | str, group: Sequence[str], order: Sequence[str]) -> Column:
    """Sum of ``value`` over the rows that come earlier, 0 for the first."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def _is_whole_scan(df: DataFrame) -> bool:
    """Whether the plan only reads files and chooses columns, and reads no path twice.

    A choice of rows may still be one of whole partitions, which the row counts tell; anything else
    than a scan is refused.
    """
    node, chosen = df._jdf.queryExecution().analyzed(), False
    while node.nodeName() in ("Project", "SubqueryAlias", "Filter", "Sample"):
        chosen = chosen or node.nodeName() in ("Filter", "Sample")
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        raise ValueError(f"scan positions need whole files, not a {node.nodeName()}")
    paths = str(node.relation().location().rootPaths().mkString("\n")).split("\n")
    return not chosen and len(paths) == len(set(paths))


def with_scan_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """Position of each row in file order, then row order, of a Parquet scan.

    ``df`` must be a scan of whole files (a choice of partitions or columns is fine); rows left
    out of a file (filtered, sampled, limited) and files read twice are found and refused.  The
    counts pass of a plain scan reads no column.  The
    offsets table has one row per input file; how many there are is known from the listing, and
    the table is broadcast unless they are too many.
    """
    scanned = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = F.count("*")
    if not _is_whole_scan(df):
        whole = (rows == F.max("_metadata.row_index") + 1) & (rows == F.count_distinct("_metadata.row_index"))
        rows = F.when(whole, rows).otherwise(F.raise_error(F.lit("scan positions need whole files, each read once")).cast("long"))
    counts = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(rows.alias("_n"))
    offsets = counts.select("_file", before("_n", [], ["_file"]).alias("_offset"))
    if len(df._jdf.inputFiles()) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return scanned.join(offsets, "_file").select(*df.columns, (F.col("_offset") + F.col("_row")).alias(name))


def _json_files(df: DataFrame) -> list[tuple[str, int]] | None:
    """Paths and lengths of the files, in name order, if ``df`` is a plain scan of JSON lines.

    A scan with options of its own, partition columns, renamed columns, or of files that Python cannot open
    is none.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        if node.nodeName() == "Project" and node.projectList().mkString(" ").find(" AS ") >= 0:
            return None
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or not node.relation().fileFormat().toString().upper().startswith("JSON"):
        return None
    relation = node.relation()
    options = str(relation.options().keys().mkString("\n")).lower().split("\n")
    if not relation.partitionSchema().isEmpty() or not {*options} <= {"", "path", "paths", "recursivefilelookup"}:
        return None
    files = sorted(scanned_files(df))
    return files if files and all(can_open(uri) for uri in {_suffix(u): u for u, _ in files}.values()) else None


def _suffix(uri: str) -> str:
    return uri[uri.rfind(".") :] if "." in uri.rsplit("/", 1)[-1] else ""


def with_line_position(
    df: DataFrame, name: str = "pos", range_bytes: int = RANGE_BYTES, path_col: str | None = None
) -> DataFrame:
    """The same for JSON lines, which have no row index; ``path_col`` adds each row's file.

    The files are cut into ranges of bytes that depend on nothing but their lengths.  One pass counts the
    lines of each range, the other reads and numbers them; neither writes or moves a line.  The ranges grow
    with the files, so that their counts stay a table that may be broadcast.  A line must hold one object.
    """
    files = _json_files(df)
    if files is None:
        located = df.select("*", decoded_path(F.col("_metadata.file_path")).alias(path_col)) if path_col else df
        return _with_written_line_position(located, name)
    spark = df.sparkSession
    spark.dataSource.register(RangedLines)
    size = max(range_bytes, -(-sum(n for _, n in files) // BROADCAST_ROWS))

    def scan(counting: bool) -> DataFrame:
        options = {"files": json.dumps(files), "range": size, "counting": str(counting).lower()}
        return spark.read.format(RangedLines.name()).options(**options).load()

    counts = stage(scan(True).select("file", "start", "number"), "line-counts")
    offsets = F.broadcast(counts.select("file", "start", before("number", [], ["file", "start"]).alias("_offset")))
    object_ = F.when(F.ltrim("line").startswith("["), F.raise_error(F.lit("JSON lines need one object a line")).cast("string"))
    parsed = F.from_json(object_.otherwise(F.col("line")), df.schema)
    lines, own = scan(False).join(offsets, ["file", "start"]), [path_col] if path_col else []
    if path_col:
        named = [(i, path) for i, (path, _) in enumerate(files)]
        lines = lines.join(small_table(spark, named, ["file", path_col], [pa.int64(), pa.string()]), "file")
    return (
        lines.select(parsed.alias("_row"), *own, (F.col("_offset") + F.col("number")).alias(name))
        .select(*[F.col("_row").getField(c).alias(c) for c in df.columns], *own, name)
    )


def _with_written_line_position(df: DataFrame, name: str) -> DataFrame:
    """Line positions of scans that only Spark can read.

    Rows of one split are read in file order and get consecutive ids, so a split's smallest id
    and the counts of the splits before it give the position.  The rows are written once, since
    ids and counts must come from the same reading.
    """
    seen = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_slot"),
    )
    rows = stage(seen, "lines")
    splits = rows.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_slot").alias("_first"))
    offsets = stage_summary(
        splits.select("_file", "_split", "_first", before("_n", [], ["_file", "_split"]).alias("_offset")), "splits"
    )
    position = F.col("_offset") + F.col("_slot") - F.col("_first")
    return rows.join(offsets, ["_file", "_split"]).select(*df.columns, position.alias(name))


def with_hash_position(
    df: DataFrame,
    key: str | Column,
    ties: Sequence[str],
    n: int | None = None,
    group: Sequence[str] = (),
    max_groups: int = 1,
    name: str = "pos",
) -> DataFrame:
    """Dense position in ``(key, ties)`` order within each ``group``; ``key`` is a stable key.

    A key that is given as an expression is not moved: it is worked out for the bucket, and again from
    the row behind the exchange.

    The frame is left in ``n`` partitions that hold consecutive key ranges, sorted.
    ``max_groups`` is the known bound on the number of groups (from a catalogue); the
    offsets table has at most ``n * max_groups`` rows and is broadcast only if that is small.
    """
    n = n or shuffle_width(df)
    group = list(group)
    slots = [*group, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket_of(key, n))
    counts = bucketed.groupBy(*slots).agg(F.count("*").alias("_n"))
    offsets = counts.select(*slots, before("_n", group, ["_bucket"]).alias("_offset"))
    if n * max_groups <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    if isinstance(key, str):
        placed = bucketed.repartitionById(n, "_bucket")
    else:
        placed = df.repartitionById(n, bucket_of(key, n)).withColumn("_key", key)
        key = "_key"
        placed = placed.withColumn("_bucket", bucket_of(key, n))
    if group:
        local = F.row_number().over(Window.partitionBy(*slots).orderBy(key, *ties)) - 1
    else:
        # Partition and bucket are the same: rows are numbered as they come out of the sort,
        # where a window would hold back the whole bucket.
        placed = placed.sortWithinPartitions(key, *ties)
        local = F.monotonically_increasing_id().bitwiseAND(_ROW_BITS)
    return (
        placed.withColumn("_local", local)
        .join(offsets, slots)
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))
    )


def with_position(df: DataFrame, order: Sequence[str], n: int | None = None, name: str = "pos") -> DataFrame:
    """Dense position under any total order of columns.

    A hot leading value (one source with a third of all rows) is spread over many range
    partitions, because the whole ``order`` decides the ranges; it must be unique.
    The range-sorted rows are written once, since both the counts and the rows must see the
    same ranges.  Pass only the columns that are needed.
    """
    n = n or shuffle_width(df)
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _SLOT_BITS)
    rows = stage(ranged, "positions").withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", before("_n", [], ["_part"]).alias("_offset"))
    if n <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    index = F.col("_slot").bitwiseAND(_ROW_BITS)
    return rows.join(offsets, "_part").select(*df.columns, (F.col("_offset") + index).alias(name))


def with_blocks(
    df: DataFrame, value: str, order: str, group: Sequence[str] = (), max_blocks: int = MAX_SUMMARY_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Cut each group's rows into consecutive blocks of ``order`` and total ``value`` per block.

    ``order`` is a long, unique within its group; best a dense position.  Returns ``df`` with
    ``_block``, and a table ``(group, _block, _offset, _sum)`` where ``_offset`` is the group's
    total before the block.  Each group is cut by its own size, into blocks of an equal share of
    rows; all groups together have at most ``max_blocks`` blocks and one more a group.  If the
    values of ``order`` lie so unevenly that a block would hold far more rows than its share, the
    rows are renumbered densely first.
    """
    group = list(group)
    stats = [F.min(order).alias("_low"), F.max(order).alias("_high"), F.count("*").alias("_rows")]
    groups = stage((df.groupBy(*group).agg(*stats) if group else df.agg(*stats)), "groups")
    rows = groups.agg(F.sum("_rows")).first()[0] or 0
    wanted = min(max_blocks, max(rows // BLOCK_ROWS, 4 * shuffle_width(df), 1))
    share = max(1, -(-rows // wanted))  # rows a block should hold
    # A group gets as many blocks as it has shares, so a large one has many and a small one a single one.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_rows") / share)).cast("long")
    span = F.col("_high") - F.col("_low") + 1
    widths = groups.select(*group, "_low", F.greatest(F.lit(1), F.ceil(span / blocks)).cast("long").alias("_width"))
    block = F.expr("(`%s` - _low) div _width" % order)
    if group:
        small = groups.count() <= BROADCAST_ROWS
        placed = df.join(F.broadcast(widths) if small else widths, group)
        blocked = placed.select(*df.columns, block.alias("_block"))
    else:
        low, width = widths.first() if rows else (0, 1)
        blocked = df.withColumn("_block", int_div(F.col(order) - F.lit(low), width))
    sums = stage(
        blocked.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows")), "blocks"
    )
    fullest = sums.agg(F.max("_rows")).first()[0] or 0
    if fullest > max(64 * BLOCK_ROWS, 8 * share):
        dense = with_position(df, [*group, order], name="_dense")
        return with_blocks(dense, value, "_dense", group, max_blocks)
    table = sums.select(*group, "_block", before("_sum", group, ["_block"]).alias("_offset"), "_sum")
    return blocked, table


def with_running_total(
    df: DataFrame, value: str, order: str, group: Sequence[str] = (), name: str = "start"
) -> DataFrame:
    """Exclusive running total of ``value`` in ``order`` within each ``group``.

    One shuffle by ``(group, block)``, whose groups are bounded by the block size, so neither
    a single group nor a hot one is summed by one task.
    """
    group = list(group)
    blocked, table = with_blocks(df, value, order, group)
    keys = [*group, "_block"]
    local = blocked.withColumn("_local", before(value, keys, [order]))
    return local.join(table, keys).select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))
