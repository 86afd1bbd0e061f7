"""Queries of the library's operators over the test tables."""

from __future__ import annotations

from weftgraph.plans import cataloged, changing, counting, expressions, graphs, guarding, handling, inference, joining, projecting, ranking, sourcing, streams, texts, validation, whatif  # noqa: F401
from weftgraph.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
