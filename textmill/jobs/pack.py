"""Turn documents into text samples, or tokenise and pack them into samples of equal length."""

from __future__ import annotations

from collections.abc import Sequence

from textmill.jobs.common import add_tokenizer, make_tokenizer, parser, session
from textmill.operators.cut import PIECE_COL, cut_texts
from textmill.operators.pack import pack, text_samples
from textmill.operators.position import with_line_position, with_scan_position
from textmill.operators.sharding import assign_shard
from textmill.operators.tokenize import separators, tokenize
from textmill.sinks.write import refuse_existing, write_corpus, write_shards
from textmill.sources.corpus import direct_files, read_corpus
from textmill.staging import drop_staged, stage


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    p.add_argument("--path", required=True, help="file or directory")
    p.add_argument("--recurse", action="store_true", help="also look into sub-directories")
    p.add_argument("--input-format", choices=["parquet", "json"], default="parquet")
    p.add_argument("--text", default="text", help="column or JSON key of the text")
    p.add_argument("--out", required=True)
    p.add_argument("--split", default="train")
    p.add_argument("--codec")
    p.add_argument("--shards", type=int, default=1)
    p.add_argument("--concat-tokens", type=int, help="length of a sample; without it: one text per document")
    add_tokenizer(p, default=None)
    p.add_argument("--bos-text", default="")
    p.add_argument("--eos-text", default="")
    p.add_argument("--bos-id", action="store_true", help="the tokeniser's own begin id before each document")
    p.add_argument("--eos-id", action="store_true", help="the tokeniser's own end id after each document")
    p.add_argument(
        "--piece-chars", type=int, help="cut texts into pieces of about so many characters before tokenising (long documents)"
    )
    p.add_argument("--no-wrap", action="store_true")
    p.add_argument("--keep-tail", action="store_true")
    p.add_argument("--no-compact", action="store_true", help="save an exchange; every task writes a file per output it holds rows of")
    a = p.parse_args(argv)
    spark = session("pack")
    refuse_existing(spark, a.out, [a.split])
    out = f"{a.out}/{a.split}"
    files = [a.path] if a.recurse else direct_files(spark, a.path)
    schema = f"`{a.text}` string" if a.input_format == "json" else None
    scan = read_corpus(spark, files, a.input_format, schema, a.recurse)
    if a.concat_tokens is None:
        write_corpus(text_samples(scan, a.text), out, codec=a.codec)
        return
    try:
        tokenizer = make_tokenizer(spark, a.tokenizer)
        before, after = separators(spark, tokenizer, a.bos_text, a.eos_text, a.bos_id, a.eos_id)
        place = with_scan_position if a.input_format == "parquet" else with_line_position
        docs = assign_shard(place(scan).select("pos", a.text), a.shards)
        if a.piece_chars:
            docs = cut_texts(docs, a.piece_chars, a.text)
        tokens = stage(tokenize(docs, tokenizer, a.text, before, after), "tokens")
        piece = PIECE_COL if a.piece_chars else None
        samples = pack(tokens, a.concat_tokens, wrap=not a.no_wrap, keep_tail=a.keep_tail, piece_col=piece)
        write_shards(samples, out, codec=a.codec, compact=not a.no_compact)
    finally:
        drop_staged(spark)


if __name__ == "__main__":
    main()
