"""The registered queries, by area, and the SQL that each must agree with."""

from __future__ import annotations

import re

from . import acronym_queries, evaluation_queries, governed_queries, language_queries, stream_queries, text_queries

AREAS = [governed_queries, text_queries, language_queries, acronym_queries, evaluation_queries, stream_queries]


def queries() -> dict:
    return {name: f for area in AREAS for name, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Decimal literals are doubles, as they are in the plans."""
    return {name: re.sub(r"(?<![\w.'%])(\d+\.\d+)(?![\w.'])", r"\1::DOUBLE", sql) for area in AREAS for name, sql in area.SQL.items()}
