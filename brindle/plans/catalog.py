"""The queries of the library proper, with their DuckDB oracles."""

from __future__ import annotations

# these modules register their queries as they are imported
from brindle.plans import allocation_queries, bailout_queries, graph_queries, heat_queries, matrix_queries, ordering_queries, pair_queries, streaming_queries, sugar_queries, text_queries  # noqa: F401
from brindle.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
