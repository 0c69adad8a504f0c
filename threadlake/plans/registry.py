"""All queries of the library outside the llm subpackage, with their SQL equivalents."""

from __future__ import annotations

from threadlake.plans import archive, core, core_sql, reference, reference_sql


def queries() -> dict:
    return core.QUERIES | reference.QUERIES | archive.QUERIES


def oracles() -> dict:
    return core_sql.SQL | reference_sql.SQL | archive.SQL
