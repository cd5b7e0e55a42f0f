"""All queries of the core, by name, and the SQL they are compared with."""

from __future__ import annotations

from weftline.plans import discovery, outputs, quality

MODULES = (discovery, quality, outputs)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
