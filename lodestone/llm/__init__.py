"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from lodestone.llm import catalogue as q

    return q.QUERIES


def sql() -> dict:
    from lodestone.llm import catalogue as q

    return q.SQL
