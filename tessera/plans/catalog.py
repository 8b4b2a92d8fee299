"""All queries of the retrieval engine by name, and their SQL."""

from __future__ import annotations

from . import catalog_data, catalog_rank, catalog_signal, catalog_stats

MODULES = (catalog_rank, catalog_data, catalog_signal, catalog_stats)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
flagship = QUERIES["per_query_metrics"]
