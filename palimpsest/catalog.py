"""The registered queries of the edit and evaluation operators, and their SQL twins."""

from __future__ import annotations

from palimpsest.plans import files, more, plan_texts
from palimpsest.plans.queries import QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in (QUERIES | more.QUERIES | files.QUERIES | plan_texts.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (QUERIES | more.QUERIES | files.QUERIES | plan_texts.QUERIES).items() if sql} | more.TWINS
