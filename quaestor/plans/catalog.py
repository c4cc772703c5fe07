"""All registered queries of the survey operators, and their SQL."""

from __future__ import annotations

from quaestor.plans import collect, describe, flows, tables  # noqa: F401  (they register their queries)
from quaestor.plans.registry import FOUND, Query


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
