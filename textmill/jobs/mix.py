"""Write the sample order of the epochs of a mixture of streams.

The configuration is JSON: ``{"streams": {"<name>": {"proportion": 0.5}, ...}}``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from textmill.config import epoch_size
from textmill.jobs.common import parser, session
from textmill.operators.mixture import blend_plan, mix, mixture_plan
from textmill.operators.shuffle import shuffle_epochs
from textmill.sinks.write import write_epochs
from textmill.sources.assets import read_bytes
from textmill.sources.streams import read_streams


def main(argv: Sequence[str] | None = None) -> None:
    p = parser(__doc__)
    p.add_argument("--root", required=True, help="samples as stream=<name>/split=<split>")
    p.add_argument("--split", default="train")
    p.add_argument("--config", required=True)
    p.add_argument("--id", default="sample", help="column that identifies a sample in its stream")
    p.add_argument("--out", required=True)
    size = p.add_mutually_exclusive_group(required=True)
    size.add_argument("--epoch-size", type=int, help="samples per epoch")
    size.add_argument("--token-budget", type=int, help="tokens per epoch; needs --length")
    p.add_argument("--length", type=int, help="tokens per sample")
    p.add_argument("--weights", action="store_true", help="proportions are weights of any sum")
    p.add_argument("--epochs", type=int, default=1)
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = session("mix")
    streams = json.loads(read_bytes(spark, a.config).decode("utf-8"))["streams"]
    shares = {name: s["proportion"] for name, s in streams.items()}
    df = read_streams(spark, a.root, a.split, list(shares)).select("stream", F.col(a.id).alias("sample_id"))
    if a.token_budget and not a.length:
        raise ValueError("a token budget needs the sample length")
    wanted = a.epoch_size or epoch_size(a.token_budget, a.length)
    plans = (blend_plan if a.weights else mixture_plan)(df, shares, wanted)
    mixed = mix(df, plans, a.seed, "sample_id")
    write_epochs(shuffle_epochs(mixed, a.seed, range(a.epochs), ["stream", "sample_id", "copy"]), a.out)


if __name__ == "__main__":
    main()
