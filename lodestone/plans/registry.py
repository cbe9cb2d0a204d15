"""All core queries by name, with their SQL."""

from __future__ import annotations

from lodestone.plans import cases, orphans, pipeline, retrieval

FLAGSHIP = "semantic_topk"
_MODULES = (orphans, retrieval, pipeline, cases)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
