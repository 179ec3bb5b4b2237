"""All registered queries of the core and their SQL."""

from __future__ import annotations

from notelake.operators import references
from notelake.plans import graph_queries, refresh_queries, search_queries, vault_queries

_MODULES = [references, graph_queries, search_queries, refresh_queries, vault_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
FLAGSHIP = "fts_stored_topk"
