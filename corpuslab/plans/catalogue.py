"""Every query by name, with its SQL."""

from __future__ import annotations

from . import calendar, curation, landed, reports, vocabulary  # noqa: F401  they register their queries
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
