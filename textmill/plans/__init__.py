"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from textmill.plans import files, ingesting, inputs, merging, mixing, ordering, sharding, splitting, tokens

_MODULES = (ordering, sharding, tokens, splitting, merging, mixing, files, inputs, ingesting)


def all_queries() -> dict:
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
