"""The queries of the reference operators and their SQL for DuckDB."""

from __future__ import annotations

from quillspark.plans import changing, chunked, graphs, judged, retrieval, streamed  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
