"""Mixtures of the language streams, epochs, batches, evaluation groups and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import SHARE_UNIT, EvalGroup, run_tokens
from textmill.operators.mixture import (
    batches,
    blend_plan,
    cyclic_pass,
    eval_group_sizes,
    eval_groups,
    mix,
    mixture_plan,
    plan_table,
    repeat_streams,
    shuffled_positions,
    token_budget,
)
from textmill.operators.position import with_scan_position
from textmill.operators.shuffle import epoch_samples, shuffle_epochs
from textmill.operators.split import right_side
from textmill.plans.splitting import _MARKED, marked_documents
from textmill.plans.tables import NUMBERED, md5_key, table
from textmill.sinks.write import read_epoch, read_epoch_slice, write_epochs
from textmill.sources.streams import catalogue_counts
from textmill.staging import staging_root

SEED = 11
BATCH = 32
RANGE_ROWS = 64
SHARES = {"en": 0.5, "de": 0.3, "fr": 0.15, "es": 0.05}
REPEATS = {"en": 1, "de": 2, "fr": 3, "es": 0}
BLEND = {"benchmark": 1.0, "documents": 1.0}
CATALOGUE = ["de", "en", "es", "fr", "gsw"]
GROUPS = [
    EvalGroup("ALL", ("en", "de", "fr", "es")),
    EvalGroup("ENG", ("en",)),
    EvalGroup("DEU", ("de", "gsw")),
    EvalGroup("ROMANCE", ("fr", "es"), repeat=2),
    EvalGroup("GSW", ("gsw",)),
]
BUDGET = run_tokens(steps=1000, batch=1152, length=4096)


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "doc_id")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _streams(spark, sf_dir)
    plans = mixture_plan(docs, SHARES, docs.count() * 3 // 2, "lang")
    return mix(docs, plans, SEED, "doc_id", "lang")


def mixture_plan_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _streams(spark, sf_dir)
    return plan_table(docs, mixture_plan(docs, SHARES, docs.count() * 3 // 2, "lang"), "lang")


def mixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned on streams and ids, drawn with all columns."""
    plans = mixture_plan(_streams(spark, sf_dir), SHARES, table(spark, sf_dir, "documents").count() * 3 // 2, "lang")
    return mix(table(spark, sf_dir, "documents"), plans, SEED, "doc_id", "lang")


def mixture_shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mixed(spark, sf_dir)
    ordered = shuffled_positions(mixed, SEED, ["lang", "doc_id", "copy"])
    total = table(spark, sf_dir, "documents").count() * 3 // 2
    return batches(ordered, BATCH, drop_last=True, total=total)


def epoch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_epochs(_mixed(spark, sf_dir), SEED, [0, 1], ["lang", "doc_id", "copy"])


def epoch_index_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second epoch, read from the kept order."""
    out = f"{staging_root(spark)}/epochs-{uuid.uuid4().hex}"
    write_epochs(epoch_index(spark, sf_dir), out)
    return read_epoch(spark, out, 1).drop("epoch")


def epoch_rank_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rank 3 of 8 has to read of the second epoch after a run that broke off at a quarter of it."""
    out = f"{staging_root(spark)}/epochs-{uuid.uuid4().hex}"
    write_epochs(epoch_index(spark, sf_dir), out, range_rows=RANGE_ROWS)
    size = table(spark, sf_dir, "documents").count() * 3 // 2
    return read_epoch_slice(spark, out, 1, first=size // 4, rank=3, ranks=8).drop("epoch")


def epoch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of an epoch, fetched by a kept order."""
    out = f"{staging_root(spark)}/epochs-{uuid.uuid4().hex}"
    write_epochs(shuffle_epochs(_mixed(spark, sf_dir), SEED, [0], ["lang", "doc_id", "copy"]), out)
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return epoch_samples(read_epoch(spark, out, 0).drop("epoch"), docs, ["lang", "doc_id"])


def cyclic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    available = docs.count()
    passes = cyclic_pass(with_scan_position(docs), available * 5 // 2, available)
    return passes.select(*docs.columns, "copy", "cycle_pos")


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_streams(table(spark, sf_dir, "documents"), REPEATS, "lang")


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = right_side(marked_documents(spark, sf_dir, "lang", "text"))
    return rows.withColumn("n_tokens", F.octet_length("text").cast("long"))


def eval_groups_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_group_sizes(_validation(spark, sf_dir), GROUPS, "n_tokens", "lang")


def eval_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_groups(_validation(spark, sf_dir).select("lang", "doc_id"), GROUPS, "lang")


def token_budget_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("lang", F.octet_length("text").alias("n_bytes"))
    return token_budget(sizes, SHARES, BUDGET, "n_bytes", "lang")


def stream_catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_counts(_streams(spark, sf_dir), CATALOGUE, "lang")


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("stream"), F.col("doc_id").alias("id"))
    bench = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("stream"), F.col("item_id").alias("id"))
    both = docs.unionByName(bench)
    return mix(both, blend_plan(both, BLEND, both.count()), SEED, "id")


QUERIES = {
    "mixture_plan": mixture_plan_by_language,
    "mixture_rows": mixture_rows,
    "mixture_shuffled_batches": mixture_shuffled_batches,
    "epoch_index": epoch_index,
    "epoch_index_kept": epoch_index_kept,
    "epoch_rank_slice": epoch_rank_slice,
    "epoch_documents": epoch_documents,
    "cyclic_pass": cyclic_documents,
    "stream_repeats": stream_repeats,
    "eval_groups": eval_groups_sizes,
    "eval_group_rows": eval_group_rows,
    "token_budget": token_budget_by_language,
    "stream_catalogue_counts": stream_catalogue_counts,
    "blend_weights": blend_weights,
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _plan(stream: str, source: str, shares: dict[str, float], size: str) -> str:
    """SQL: largest-remainder plan of the streams of ``source``."""
    units = [(name, round(share * SHARE_UNIT)) for name, share in shares.items()]
    total = sum(u for _, u in units)
    return f"""
    shares(stream, units) as (values {_values(units)}),
    epoch as (select {size} as size from {source}),
    counts as (select {stream} as stream, count(*) as n_available from {source} group by 1),
    parts as (
        select stream, n_available, size,
            cast(cast(units as hugeint) * size // {total} as bigint) as whole,
            cast(units as hugeint) * size % {total} as rest
        from shares join counts using (stream), epoch),
    needs as (
        select stream, n_available,
            whole + cast(row_number() over (order by rest desc, stream) <= size - sum(whole) over () as bigint)
                as n_needed
        from parts),
    plan as (
        select *, n_needed // n_available as full_copies, n_needed % n_available as remainder from needs)"""


def _mix(stream: str, id_col: str, source: str) -> str:
    """SQL: rows of the planned epoch."""
    return f"""
    ranked as (
        select {stream} as stream, {id_col} as id,
            row_number() over (partition by {stream} order by {md5_key(SEED, stream, id_col)}, {id_col}) as rank
        from {source}),
    mixed as (
        select stream, id, unnest(range(full_copies + cast(rank <= remainder as bigint))) as copy
        from ranked join plan using (stream))"""


_LANG_PLAN = _plan("lang", "documents", SHARES, "count(*) * 3 // 2")
_LANG_MIX = f"{_LANG_PLAN}, {_mix('lang', 'doc_id', 'documents')}"


def _epoch(number: int) -> str:
    key = md5_key(SEED, str(number), "stream", "id", "copy")
    return f"""
    select {number} as epoch, row_number() over (order by {key}, stream, id, copy) - 1 as pos,
        stream as lang, id as doc_id, copy
    from mixed"""


_MEMBERS = _values([(g.label, s, g.repeat) for g in GROUPS for s in g.streams])

ORACLES = {
    "mixture_plan": f"""
        with {_LANG_PLAN}
        select stream as lang, n_available, n_needed, full_copies, remainder from plan""",
    "mixture_rows": f"with {_LANG_MIX} select documents.*, copy from mixed join documents on doc_id = id",
    "mixture_shuffled_batches": f"""
        with {_LANG_MIX}, ordered as ({_epoch(0)})
        select lang, doc_id, copy, pos, pos // {BATCH} as batch from ordered
        where pos < (select size from epoch) // {BATCH} * {BATCH}""",
    "epoch_index": f"with {_LANG_MIX} {_epoch(0)} union all {_epoch(1)}",
    "epoch_index_kept": f"with {_LANG_MIX}, kept as ({_epoch(1)}) select pos, lang, doc_id, copy from kept",
    "epoch_rank_slice": f"""
        with {_LANG_MIX}, kept as ({_epoch(1)}),
        sized as (select size // 4 as first, (size - size // 4) // 8 as share, (size - size // 4) % 8 as rest from epoch)
        select pos, lang, doc_id, copy from kept, sized
        where pos >= first + 3 * share + least(3, rest) and pos < first + 4 * share + least(4, rest)""",
    "epoch_documents": f"""
        with {_LANG_MIX}, kept as ({_epoch(0)})
        select pos, kept.lang, kept.doc_id, copy, text from kept join documents using (doc_id)""",
    "cyclic_pass": f"""
        with {NUMBERED}, sized as (select count(*) as n from documents)
        select numbered.* exclude (pos), copy, copy * n + pos as cycle_pos
        from numbered, sized, (select unnest(range(3)) as copy)
        where copy * n + pos < n * 5 // 2""",
    "stream_repeats": f"""
        with repeats(lang, n) as (values {_values(list(REPEATS.items()))})
        select documents.*, unnest(range(n)) as copy from documents join repeats using (lang)""",
    "eval_groups": f"""
        with {_MARKED}, members(label, lang, n) as (values {_MEMBERS}),
        valid as (select lang, octet_length(encode(text)) as n_tokens from marked where is_right)
        select label, count(distinct lang) as n_streams, cast(sum(n) as bigint) as n_samples,
            cast(sum(n_tokens * n) as bigint) as n_tokens
        from valid join members using (lang) group by 1""",
    "eval_group_rows": f"""
        with {_MARKED}, members(label, lang, n) as (values {_MEMBERS})
        select lang, doc_id, label, unnest(range(n)) as copy
        from marked join members using (lang) where is_right""",
    "token_budget": f"""
        with shares(lang, proportion) as (values {_values([(k, v) for k, v in SHARES.items()])}),
        held as (select lang, cast(sum(octet_length(encode(text))) as bigint) as n_tokens from documents group by 1)
        select lang, coalesce(n_tokens, 0) as n_tokens,
            cast(round(cast(proportion as double) * {BUDGET}) as bigint) as n_needed,
            cast(proportion as double) * {BUDGET} / n_tokens as passes
        from shares left join held using (lang)""",
    "stream_catalogue_counts": f"""
        with streams(lang) as (values {_values([(s,) for s in CATALOGUE])}),
        counts as (select lang, count(*) as n from documents group by 1)
        select lang, coalesce(n, 0) as n_samples from streams left join counts using (lang)
        where coalesce(n, 0) > 0""",
    "blend_weights": f"""
        with both_streams as (
            select 'documents' as stream, doc_id as id from documents
            union all select 'benchmark', item_id from benchmark),
        {_plan('stream', 'both_streams', {'benchmark': 0.5, 'documents': 0.5}, 'count(*)')},
        {_mix('stream', 'id', 'both_streams')}
        select stream, id, copy from mixed""",
}
