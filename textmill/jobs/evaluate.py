"""Write the evaluation groups of a root of streams, and what a run's token budget asks of its streams.

The configuration is JSON: ``{"streams": {"<name>": {"proportion": 0.5}}, "groups": {"<label>":
{"streams": ["<name>"], "repeat": 1}}}``.  Without one the preset streams and groups are taken.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from textmill import presets
from textmill.config import EvalGroup, run_tokens
from textmill.jobs.common import parser, session
from textmill.operators.mixture import eval_group_sizes, eval_groups, token_budget
from textmill.sinks.write import write_corpus
from textmill.sources.assets import read_bytes
from textmill.sources.streams import read_streams


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    p.add_argument("--root", required=True, help="samples as stream=<name>/split=<split>")
    p.add_argument("--split", default="val", help="split of the evaluation groups")
    p.add_argument("--train-split", default="train", help="split of the token budget")
    p.add_argument("--config")
    p.add_argument("--out", required=True, help="gets groups, sizes and, with --steps, budget")
    p.add_argument("--steps", type=int, help="training steps; needs --batch and --length")
    p.add_argument("--batch", type=int)
    p.add_argument("--length", type=int)
    p.add_argument("--codec")
    a = p.parse_args(argv)
    if a.steps and not (a.batch and a.length):
        raise ValueError("a token budget needs --steps, --batch and --length")
    spark = session("evaluate")
    if a.config:
        config = json.loads(read_bytes(spark, a.config).decode("utf-8"))
        shares = {name: s["proportion"] for name, s in config["streams"].items()}
        groups = [EvalGroup(n, tuple(g["streams"]), g.get("repeat", 1)) for n, g in config["groups"].items()]
    else:
        shares, groups = presets.TRAIN_SHARES, presets.eval_groups()
    named = sorted({s for g in groups for s in g.streams})
    rows = read_streams(spark, a.root, a.split, named)
    sized = F.size("tokens").cast("long").alias("n_tokens")
    write_corpus(eval_groups(rows, groups), f"{a.out}/groups", codec=a.codec, mode="errorifexists")
    sizes = eval_group_sizes(rows.select("stream", sized), groups, "n_tokens")
    write_corpus(sizes.coalesce(1), f"{a.out}/sizes", codec=a.codec, mode="errorifexists")
    if a.steps:
        train = read_streams(spark, a.root, a.train_split, list(shares)).select("stream", sized)
        budget = token_budget(train, shares, run_tokens(a.steps, a.batch, a.length), "n_tokens")
        write_corpus(budget.coalesce(1), f"{a.out}/budget", codec=a.codec, mode="errorifexists")


if __name__ == "__main__":
    main()
