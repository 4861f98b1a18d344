"""All queries over the proxy tables and the SQL that checks them."""

from __future__ import annotations

from cellweave.plans import cell_queries, proxy, spatial_queries  # noqa: F401  registered on import


def queries() -> dict:
    return dict(proxy.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(proxy.ORACLES)
