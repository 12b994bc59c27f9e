"""All registered queries."""

from __future__ import annotations

from framewell.plans import service, timeline  # noqa: F401
from framewell.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
