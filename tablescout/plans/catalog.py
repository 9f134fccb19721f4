"""All named queries with the SQL that must give the same tables."""

from __future__ import annotations

from . import dirty_cases, pivot_cases, source_cases, stats_cases, view_cases

CASES = {**stats_cases.CASES, **view_cases.CASES, **pivot_cases.CASES, **source_cases.CASES, **dirty_cases.CASES}


def queries() -> dict:
    return {name: query for name, (query, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items() if sql is not None}
