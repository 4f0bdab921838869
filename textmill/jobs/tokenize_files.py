"""Tokenise each input file into an indexed dataset of its own."""

from __future__ import annotations

from collections.abc import Sequence

from textmill.jobs.common import add_inputs, add_tokenizer, make_tokenizer, parser, session
from textmill.operators.indexed import indexed_datasets
from textmill.sinks.write import write_per_file
from textmill.sources.files import resolve_inputs
from textmill.staging import drop_staged


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    add_inputs(p)
    add_tokenizer(p)
    p.add_argument("--keys", default="text", help="comma-separated keys; each makes datasets of its own")
    p.add_argument("--append-eod", action="store_true", help="end each document with the tokeniser's end id")
    p.add_argument("--out", required=True)
    p.add_argument("--no-compact", action="store_true", help="save an exchange; every task writes a file per output it holds rows of")
    a = p.parse_args(argv)
    spark = session("tokenize-files")
    paths = resolve_inputs(spark, a.files, a.glob, a.shard, a.n_shards)
    tokenizer = make_tokenizer(spark, a.tokenizer)
    if a.append_eod and tokenizer.eos_id is None:
        raise ValueError("the tokeniser has no end id")
    base = a.out.rstrip("/").rsplit("/", 1)[-1]
    try:
        for key in a.keys.split(","):
            schema = f"`{key}` string" if a.input_format == "json" else None
            eod = tokenizer.eos_id if a.append_eod else None
            items = indexed_datasets(spark, paths, tokenizer, a.input_format, key, schema, eod, by_file=not a.no_compact)
            write_per_file(items, f"{a.out}/{key}", base, len(paths), key=key, compact=False)
    finally:
        drop_staged(spark)


if __name__ == "__main__":
    main()
