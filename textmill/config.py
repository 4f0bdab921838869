"""Plain configuration records: streams, their shares, evaluation groups."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

SHARE_UNIT = 10**15


@dataclass(frozen=True)
class EvalGroup:
    label: str
    streams: tuple[str, ...]
    repeat: int = 1


@dataclass(frozen=True)
class StreamPlan:
    """What one stream gives to an epoch: all its rows ``full_copies`` times, then ``remainder``."""

    stream: str
    available: int
    needed: int

    @property
    def full_copies(self) -> int:
        return self.needed // self.available if self.available else 0

    @property
    def remainder(self) -> int:
        return self.needed % self.available if self.available else 0


def epoch_size(token_budget: int, length: int) -> int:
    """Samples of ``length`` tokens that a token budget pays for."""
    return token_budget // length


def run_tokens(steps: int, batch: int, length: int) -> int:
    """Tokens that a training run of so many steps reads."""
    return steps * batch * length


def check_shares(shares: Mapping[str, float]) -> None:
    """Proportions must add up to 1 (to within their written precision)."""
    if abs(sum(shares.values()) - 1.0) > 1e-6:
        raise ValueError(f"proportions add up to {sum(shares.values())}, not 1")


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {name: w / total for name, w in weights.items()}


def apportion(shares: Mapping[str, float], size: int) -> dict[str, int]:
    """Split ``size`` by shares, largest remainder first (ties by name), so the parts add up.

    Shares are taken as whole multiples of ``1 / SHARE_UNIT``: the result does not hang on float
    rounding, and a share of a few billionths keeps eight digits.
    """
    units = {name: round(share * SHARE_UNIT) for name, share in shares.items()}
    total = sum(units.values())
    exact = {name: Fraction(u * size, total) for name, u in units.items()}
    parts = {name: int(x) for name, x in exact.items()}
    spare = size - sum(parts.values())
    by_rest = sorted(exact, key=lambda name: (parts[name] - exact[name], name))
    for name in by_rest[:spare]:
        parts[name] += 1
    return parts


def plan_mixture(counts: Mapping[str, int], shares: Mapping[str, float], size: int) -> list[StreamPlan]:
    """Plan of an epoch of ``size`` samples from streams with the given sample counts."""
    plans = [StreamPlan(s, counts.get(s, 0), need) for s, need in sorted(apportion(shares, size).items())]
    empty = [p.stream for p in plans if p.needed and not p.available]
    if empty:
        raise ValueError(f"streams without samples have a share: {', '.join(empty)}")
    return plans
