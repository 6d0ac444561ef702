"""All queries of the core engine, with the SQL that checks them where SQL can say it.

Names begin with the row of the operator inventory; rows P01 to P26, the projections,
get ``proj_`` in front, so that they are not taken for the training-data problems pN_.
"""

from __future__ import annotations

import re

from siltstone.plans import analytics, catalog, codebase, extras, graphs, instants, quality, reports, search, sessions, text

MODULES = (instants, text, search, analytics, graphs, quality, catalog, extras, codebase, sessions, reports)


def _named(name: str) -> str:
    return f"proj_{name}" if re.match(r"p\d\d_", name) else name


def queries() -> dict:
    return {_named(name): f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {_named(name): sql for m in MODULES for name, sql in m.ORACLES.items()}
