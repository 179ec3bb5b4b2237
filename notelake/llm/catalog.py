"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from notelake.llm import abuse, bpe, mapping, mixing, neardup, splitting, vectors

_MODULES = [vectors, mapping, splitting, neardup, bpe, mixing, abuse]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
