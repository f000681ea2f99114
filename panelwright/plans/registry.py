"""All queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from . import consolidated, content, evidence, framing, panel, predicates, records, reports, storage

MODULES = (reports, content, panel, evidence, consolidated, predicates, framing, records, storage)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: statement for m in MODULES for name, statement in m.ORACLES.items()}
