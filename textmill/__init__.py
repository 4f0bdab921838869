"""Textmill: corpus preparation for language-model training as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` with plain parameters.
The caller owns the session; nothing here keeps a global one.
"""

from textmill.config import EvalGroup, StreamPlan, epoch_size, run_tokens
from textmill.operators.audit import text_audit, token_range_audit, token_report
from textmill.operators.cut import cut_texts
from textmill.operators.identity import number_copies, with_row_id, with_scan_id
from textmill.operators.indexed import indexed_datasets
from textmill.operators.merge import append_parts, document_bounds, merge_indexed, merge_samples
from textmill.operators.mixture import (
    batches,
    blend_plan,
    cyclic_pass,
    eval_group_sizes,
    eval_groups,
    mix,
    mixture_plan,
    repeat_streams,
    shuffled_positions,
    token_budget,
)
from textmill.operators.pack import pack, pack_report, text_samples
from textmill.operators.position import (
    with_hash_position,
    with_line_position,
    with_position,
    with_running_total,
    with_scan_position,
)
from textmill.operators.sharding import assign_shard
from textmill.operators.shuffle import shuffle, shuffle_epochs
from textmill.operators.split import audit_split, left_side, only, right_side, split, without
from textmill.operators.tokenize import (
    Tokenizer,
    bpe_tokenizer,
    byte_tokenizer,
    callable_tokenizer,
    separators,
    tokenize,
)
from textmill.sinks.write import in_order, refuse_existing, write_corpus, write_shards, write_split
from textmill.sources.corpus import first_n, read_corpus
from textmill.sources.files import resolve_inputs
from textmill.sources.streams import catalogue_counts, read_streams
from textmill.staging import drop_staged, stage
from textmill.streaming.ingest import ingest

__version__ = "0.1.0"

__all__ = [
    "EvalGroup",
    "StreamPlan",
    "Tokenizer",
    "append_parts",
    "assign_shard",
    "audit_split",
    "batches",
    "blend_plan",
    "bpe_tokenizer",
    "byte_tokenizer",
    "callable_tokenizer",
    "catalogue_counts",
    "cut_texts",
    "cyclic_pass",
    "document_bounds",
    "drop_staged",
    "epoch_size",
    "eval_group_sizes",
    "eval_groups",
    "first_n",
    "in_order",
    "indexed_datasets",
    "ingest",
    "left_side",
    "merge_indexed",
    "merge_samples",
    "mix",
    "mixture_plan",
    "number_copies",
    "only",
    "pack",
    "pack_report",
    "read_corpus",
    "read_streams",
    "refuse_existing",
    "repeat_streams",
    "resolve_inputs",
    "right_side",
    "run_tokens",
    "separators",
    "shuffle",
    "shuffle_epochs",
    "shuffled_positions",
    "split",
    "stage",
    "text_audit",
    "text_samples",
    "token_budget",
    "token_range_audit",
    "token_report",
    "tokenize",
    "with_hash_position",
    "with_line_position",
    "with_position",
    "with_row_id",
    "with_running_total",
    "with_scan_id",
    "with_scan_position",
    "without",
    "write_corpus",
    "write_shards",
    "write_split",
]
