"""All queries outside the llm subpackage."""

from __future__ import annotations

from ridgevec.plans import core, problems


def queries() -> dict:
    return {**core.QUERIES, **problems.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**core.SQL, **problems.SQL}
