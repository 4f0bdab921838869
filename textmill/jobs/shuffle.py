"""Read a corpus, put it into a random order, write it as a number of files."""

from __future__ import annotations

from collections.abc import Sequence

from textmill.jobs.common import add_inputs, parser, session
from textmill.operators.identity import with_scan_id
from textmill.operators.shuffle import shuffle
from textmill.sinks.write import write_corpus
from textmill.sources.corpus import read_corpus
from textmill.sources.files import resolve_inputs


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    add_inputs(p)
    p.add_argument("--out", required=True)
    p.add_argument("--n-files", type=int, required=True, help="output files, e.g. one per worker")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--key", help="unique column that identifies a row; default: file and row number, or")
    p.add_argument("--by-content", action="store_true", help="the whole row (always so for JSON)")
    p.add_argument("--schema", help="columns and types of the input; without it JSON is read once more to infer them")
    p.add_argument("--emit-pos", action="store_true", help="also write the position as shuffle_pos")
    p.add_argument("--layout-order", action="store_true", help="sort by rand(seed) instead of a stable key")
    p.add_argument("--output-format", choices=["parquet", "json"], default="parquet")
    p.add_argument("--codec", help="'none' or '' for no compression")
    a = p.parse_args(argv)
    spark = session("shuffle")
    paths = resolve_inputs(spark, a.files, a.glob, a.shard, a.n_shards)
    df = read_corpus(spark, paths, a.input_format, a.schema)
    key = a.key
    if key is None and a.input_format == "parquet" and not (a.by_content or a.layout_order):
        df, key = with_scan_id(df, "_row"), "_row"
    ordered = shuffle(df, a.n_files, a.seed, key, a.emit_pos, stable=not a.layout_order)
    write_corpus(ordered.drop("_row"), a.out, a.output_format, a.codec)


if __name__ == "__main__":
    main()
