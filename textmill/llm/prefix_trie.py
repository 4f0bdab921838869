"""The trie of conversation prefixes, with facts about every subtree by the Euler-tour technique.

Turns are ordered by a distributed sort and known by a hash of role and text.  A prefix is known by its
length and two running sums (exclusive or) of its turns' hashes with their places, so that a very long
conversation is cut into blocks like any other.  Equal prefixes are one node.  The smallest member of a
node is the smallest of one of its children, too, if it goes on; so each conversation owns a path of nodes,
numbered one after the other, and only the tops of paths have to be hung below a parent.

The tour enters and leaves each node once: an enter and an exit arc per node.  The arcs are ranked
(``euler_tour.list_ranks``), and sums over the arcs in front of a node's two arcs, taken from each other,
are the sums over its subtree.

Null roles and texts are empty; turns without a conversation id are left out.  Turns of one conversation
with equal numbers are ordered by the MD5 of their roles' and texts' MD5s; equal turns stay as often as
they occur.  No conversations give no node.  A very long text is hashed by the task that reads it and
moves nowhere.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.bytesops import released_batches
from textmill.llm.euler_tour import list_ranks, prefix_sums
from textmill.operators.position import with_position
from textmill.staging import stage

GROUP = 100  # conversations that share the head of their first
SHARED = 6  # shared turns: fewer than this
RUN_BITS = 16
CHUNK = 1024
_KEY = ["depth", "k1", "k2"]


def _run(pos: str | Column) -> Column:
    return F.shiftright(pos, RUN_BITS)


def _over_runs(runs: DataFrame) -> DataFrame:
    """One row for each block of positions that a run ``(_first, _size)`` covers."""
    return runs.withColumn("_run", F.explode(F.sequence(_run(F.col("_first")), _run(F.col("_first") + F.col("_size") - 1))))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, turn_hash, n_chars)``: ``at`` numbers all turns, by conversation and place."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.md5(role), F.md5(text)))).alias("turn_hash"),
        F.char_length(text).cast("long").alias("n_chars"),
    )
    return with_position(turns, ["conv_id", "turn", "turn_hash"], name="at").drop("turn")


def rebuilt_turns(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, depth, total, turn_hash, n_chars)`` and conversations ``(conv_id, total)``.

    The first ``crc32(conv_id) % shared`` turns of a conversation are those of the first of its group.
    """
    turns = ordered_turns(conversations)
    found = turns.groupBy("conv_id").agg(F.min("at").alias("_first"), F.count("*").alias("_size"))
    sized = stage(
        found.select(
            "*",
            (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("_head"),
            (F.col("conv_id") - F.col("conv_id") % group).alias("_base"),
        ),
        "conversations",
    )
    bases = sized.select(F.col("conv_id").alias("_base"), F.col("_size").alias("_base_size"))
    taken = F.least("_head", F.coalesce("_base_size", F.lit(0)))
    convs = sized.join(bases, "_base", "left").select(
        "*", taken.alias("_taken"), (taken + F.greatest(F.col("_size") - F.col("_head"), F.lit(0))).alias("total")
    )
    # Positions of a conversation are consecutive: blocks of them make its rows meet its facts without a hot key.
    placed = turns.withColumn("_run", _run("at")).join(_over_runs(convs), ["_run", "conv_id"])
    place = F.col("at") - F.col("_first")
    own = placed.where(place >= F.col("_head")).select(
        "conv_id", (F.col("_taken") + place - F.col("_head") + 1).alias("depth"), "total", "turn_hash", "n_chars"
    )
    heads = placed.where((F.col("conv_id") == F.col("_base")) & (place < shared)).select(
        "_base", (place + 1).alias("depth"), "turn_hash", "n_chars"
    )
    given = heads.join(convs.select("conv_id", "_base", "_taken", "total"), "_base").where("depth <= _taken")
    return own.unionByName(given.select(*own.columns)), convs.select("conv_id", "total")


def prefixes(turns: DataFrame, block_bits: int = 12) -> DataFrame:
    """Turns with the key ``(depth, k1, k2)`` of the prefix they end and the sums of the one before."""
    own = {"k1": F.xxhash64("turn_hash", "depth"), "k2": F.xxhash64("depth", "turn_hash")}
    rows = turns.select(
        "conv_id",
        "depth",
        "total",
        "n_chars",
        *[x.alias(f"x{k}") for k, x in own.items()],
        F.shiftright(F.col("depth") - 1, block_bits).alias("_block"),
    )
    sums = (
        rows.where(F.col("total") > 1 << block_bits)
        .groupBy("conv_id", "_block")
        .agg(*[F.bit_xor(f"x{k}").alias(k) for k in own])
    )
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "_block", *[F.bit_xor(k).over(earlier).alias(f"o{k}") for k in own])
    so_far = Window.partitionBy("conv_id", "_block").orderBy("depth")
    local = rows.join(offsets, ["conv_id", "_block"], "left").select(
        "*",
        *[F.bit_xor(f"x{k}").over(so_far).bitwiseXOR(F.coalesce(f"o{k}", F.lit(0))).alias(k) for k in own],
    )
    return local.select(
        "conv_id",
        "depth",
        "total",
        "n_chars",
        *own,
        *[F.col(k).bitwiseXOR(F.col(f"x{k}")).alias(f"p{k[1]}") for k in own],
    )


def trie_nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes ``(id, conv_id, depth, k1, k2, p1, p2, n_convs, n_chars, last)``, numbered by owner and depth.

    ``last`` marks the last node of its owner.
    """
    zero = F.lit(0).cast("long")
    found = paths.groupBy(*_KEY).agg(
        F.min(F.struct("conv_id", "total")).alias("_owner"),
        F.count("*").alias("n_convs"),
        F.min("n_chars").alias("n_chars"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    root = convs.agg(F.min(F.struct("conv_id", "total")).alias("_owner"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("*", *[zero.alias(c) for c in (*_KEY, "n_chars", "p1", "p2")])
    nodes = found.unionByName(root).select(
        F.col("_owner.conv_id").alias("conv_id"),
        *_KEY,
        "p1",
        "p2",
        "n_convs",
        "n_chars",
        (F.col("_owner.total") == F.col("depth")).alias("last"),
    )
    return with_position(nodes, ["conv_id", "depth"], name="id")


def _tops(nodes: DataFrame) -> DataFrame:
    """The first node of each owner, except for the root."""
    owners = nodes.groupBy("conv_id").agg(F.min("id").alias("_first"), F.count("*").alias("_size"))
    return (
        nodes.withColumn("_run", _run("id"))
        .join(_over_runs(owners), ["_run", "conv_id"])
        .where("id = _first and depth > 0")
        .select("id", "conv_id", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    )


def hung(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the tops of paths hang.

    Returns ``(id, parent, parent_conv, next)`` for the tops, ``next`` being the next top below the same
    parent, and ``(id, first_top, n_tops)`` for the parents.  Tops are sorted by parent and numbered; a
    parent meets its tops block by block of these numbers, however many it has.
    """
    tops = stage(with_position(_tops(nodes), [*_KEY, "id"], name="at"), "tops")
    runs = tops.groupBy(*_KEY).agg(
        F.min("at").alias("_first"), F.count("*").alias("_size"), F.min("id").alias("first_top")
    )
    parents = stage(
        runs.join(nodes.select(*_KEY, F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv")), _KEY), "parents"
    )
    after = tops.select((F.col("at") - 1).alias("at"), F.col("id").alias("_next"))
    placed = (
        tops.join(after, "at", "left")
        .withColumn("_run", _run("at"))
        .join(_over_runs(parents), ["_run", *_KEY])
        .select(
            "id",
            "parent",
            "parent_conv",
            F.when(F.col("at") + 1 < F.col("_first") + F.col("_size"), F.col("_next")).alias("next"),
        )
    )
    return stage(placed, "hung"), parents.select(F.col("parent").alias("id"), "first_top", F.col("_size").alias("n_tops"))


def _tour(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Arcs ``(id, next)``: node ``v`` is entered by arc ``2 v`` and left by ``2 v + 1``.

    ``nodes`` has ``first_top``.  The children of a node are the next node of its owner, if any, and then
    the tops that hang below it.
    """
    enter, leave = 2 * F.col("id"), 2 * F.col("id") + 1
    aside = F.coalesce(2 * F.col("first_top"), leave)
    going_in = F.struct(enter.alias("id"), F.when(F.col("last"), aside).otherwise(enter + 2).alias("next"))
    coming_back = F.struct((leave + 2).alias("id"), aside.alias("next"))
    arcs = nodes.select(
        F.explode(F.when(F.col("last"), F.array(going_in)).otherwise(F.array(going_in, coming_back))).alias("a")
    ).select("a.*")
    sideways = tops.select(leave.alias("id"), F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("next"))
    root = nodes.where("depth = 0").select(leave.alias("id"), F.lit(None).cast("long").alias("next"))
    return arcs.unionByName(sideways).unionByName(root)


@released_batches
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's consecutive chunks, joined by commas."""
    key, sha = None, None
    for batch in batches:
        done: list[tuple] = []
        for *now, chunk in zip(*[c.to_pylist() for c in batch.columns]):
            if now == key:
                sha.update(b"," + chunk.encode())
            else:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256(chunk.encode())
        if done:
            yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows])],
        names=[*_KEY, "ends_sha256"],
    )


def end_digests(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` for the prefixes at which conversations end.

    The ids are sorted and numbered, chunks of them joined; a hash runs over the chunks of its prefix one
    after the other, so that no task holds the ids of a prefix, however many end there.
    """
    zero = F.lit(0).cast("long")
    ends = paths.where("depth = total").select(*_KEY, "conv_id")
    ends = ends.unionByName(convs.where("total = 0").select(*[zero.alias(c) for c in _KEY], "conv_id"))
    chunks = (
        with_position(ends, [*_KEY, "conv_id"], name="at")
        .groupBy(*_KEY, F.floor(F.col("at") / CHUNK).alias("_chunk"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    )
    return (
        chunks.repartition(*_KEY)
        .sortWithinPartitions(*_KEY, "_chunk")
        .select(*_KEY, "ids")
        .mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations ``(conv_id, depth, total, turn_hash, n_chars)``.

    ``convs`` has ``(conv_id, total)``, also for conversations without turns.
    """
    paths = stage(prefixes(turns), "prefixes")
    convs = stage(convs, "totals")
    nodes = stage(trie_nodes(paths, convs), "nodes")
    tops, parents = hung(nodes)
    nodes = nodes.join(parents, "id", "left")
    weighed = nodes.select(
        (2 * F.col("id")).alias("id"),
        (F.col("last") & F.col("first_top").isNull()).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    arcs = list_ranks(_tour(nodes, tops)).join(weighed, "id", "left").fillna(0, ["n_leaves", "saved_tokens"])
    sums = prefix_sums(stage(arcs, "arcs"), "pos", ["n_leaves", "saved_tokens"])
    below = sums.groupBy(F.shiftright("id", 1).alias("id")).agg(
        *[(F.max(c) - F.min(c)).alias(c) for c in ("n_leaves", "saved_tokens")]
    )
    children = F.coalesce("n_tops", F.lit(0)) + (~F.col("last")).cast("long")
    own = F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(tops.select("id", "parent_conv"), "id", "left")
        .join(below, "id")
        .join(end_digests(paths, convs), _KEY, "left")
        .select(
            "conv_id",
            "depth",
            own.alias("parent_conv_id"),
            "n_convs",
            children.alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """The trie of rebuilt conversations."""
    return prefix_trie(*rebuilt_turns(conversations, group, shared))
