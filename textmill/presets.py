"""A ready mixture of seventeen language streams and its evaluation groups.

Fixed values: names, proportions and groups that a run with these streams must use.
"""

from __future__ import annotations

from textmill.config import EvalGroup

# Share of each stream in a training epoch.
TRAIN_SHARES = {
    "afr": 0.001352385557433215,
    "code": 0.30796839684273686,
    "dan": 0.026670310486060417,
    "deu": 0.18943002978106832,
    "eng": 0.3482448942858498,
    "fao": 8.52162600850915e-05,
    "fry": 5.4024485718372014e-05,
    "gsw": 4.926151316429887e-08,
    "isl": 0.007897999882605708,
    "lim": 8.771628187817968e-06,
    "ltz": 5.117039679941545e-06,
    "nds": 2.4733384734575056e-06,
    "nld": 0.06885193947903728,
    "nno": 0.0007914016032073252,
    "nob": 0.0146845697154507,
    "nor": 0.00270379204229229,
    "swe": 0.031248628310600237,
}

# Fixed value: streams that have training samples only.
WITHOUT_VALIDATION = ("gsw",)

# Fixed value: training tokens of one epoch.
EPOCH_TOKENS = 10_000_000_000_000

# Evaluation groups, besides the one of all streams.
_GROUPS = {
    "ENG": ("eng",),
    "CODE": ("code",),
    "DEU": ("deu", "ltz", "nds"),
    "NLD": ("nld", "afr", "fry", "lim"),
    "SWE": ("swe",),
    "DAN": ("dan",),
    "NOR": ("nob", "nor"),
    "NNO": ("nno",),
    "ISL": ("isl",),
    "FAO": ("fao",),
}


def eval_groups() -> list[EvalGroup]:
    """All groups; ``ALL`` holds every stream that has validation samples."""
    everything = tuple(s for s in TRAIN_SHARES if s not in WITHOUT_VALIDATION)
    return [EvalGroup("ALL", everything), *[EvalGroup(label, streams) for label, streams in _GROUPS.items()]]
