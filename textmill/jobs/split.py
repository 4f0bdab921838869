"""Split a packed dataset at random into a large and a small part."""

from __future__ import annotations

from collections.abc import Sequence

from textmill.jobs.common import parser, session
from textmill.operators.identity import with_scan_id
from textmill.operators.split import RIGHT_MAX, RIGHT_PROB, SEED, split
from textmill.sinks.write import write_split_paths
from textmill.sources.packed import read_packed


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    p.add_argument("--path", required=True)
    p.add_argument("--left-path", default="train")
    p.add_argument("--right-path", default="valid")
    p.add_argument("--right-prob", type=float, default=RIGHT_PROB, help="chance of a sample to go right")
    p.add_argument("--right-max", type=int, default=RIGHT_MAX, help="rough most samples on the right")
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--codec")
    a = p.parse_args(argv)
    spark = session("split")
    df, kind = read_packed(spark, a.path)
    numbered = [c for c in ("shard", "seq") if c in df.columns]
    if len(numbered) == 2:
        marked = split(df, numbered, a.right_prob, a.right_max, a.seed)
    else:
        marked = split(with_scan_id(df, "_id"), "_id", a.right_prob, a.right_max, a.seed).drop("_id")
    write_split_paths(marked, a.left_path, a.right_path, codec=a.codec)


if __name__ == "__main__":
    main()
