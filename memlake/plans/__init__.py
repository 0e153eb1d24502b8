"""Registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from memlake.plans import memory, retrieval, work

QUERIES: dict = retrieval.QUERIES | work.QUERIES | memory.QUERIES
ORACLES: dict[str, str] = retrieval.ORACLES | work.ORACLES | memory.ORACLES
