"""Tokenise the files that are new in a directory and append them to a table."""

from __future__ import annotations

from collections.abc import Sequence

from textmill.jobs.common import add_tokenizer, make_tokenizer, parser, session
from textmill.streaming.ingest import ingest


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    p.add_argument("--path", required=True)
    p.add_argument("--schema", default="text string", help="columns of the input, as DDL")
    p.add_argument("--input-format", choices=["parquet", "json"], default="json")
    p.add_argument("--text", default="text")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--max-files", type=int, help="files per batch")
    p.add_argument("--spread", type=int, help="tasks to deal the rows of few small files out to")
    p.add_argument("--append-eod", action="store_true")
    add_tokenizer(p)
    a = p.parse_args(argv)
    spark = session("ingest")
    tokenizer = make_tokenizer(spark, a.tokenizer)
    eod = tokenizer.eos_id if a.append_eod else None
    query = ingest(
        spark,
        a.path,
        a.out,
        a.checkpoint,
        tokenizer,
        a.schema,
        a.input_format,
        a.text,
        eod,
        a.max_files,
        a.spread,
    )
    query.awaitTermination()


if __name__ == "__main__":
    main()
