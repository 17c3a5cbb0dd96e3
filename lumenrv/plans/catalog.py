"""Registry of the queries and of the SQL that gives the same rows."""

from __future__ import annotations

from lumenrv.plans import axes, expressions, inputs, kernels, orders, pixels, sequences, stages, statistics, surface  # noqa: F401  (they register their queries)
from lumenrv.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
