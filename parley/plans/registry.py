"""All queries of the analytics operators, and their SQL."""

from __future__ import annotations

from parley.plans import archive, datasets, operations, texts, training

MODULES = (archive, texts, datasets, operations, training)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
