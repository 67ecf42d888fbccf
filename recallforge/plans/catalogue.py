"""The queries of the engine's own operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from recallforge.plans import retrieval, stateful

QUERIES = retrieval.QUERIES | stateful.QUERIES
ORACLE = retrieval.ORACLE | stateful.ORACLE
