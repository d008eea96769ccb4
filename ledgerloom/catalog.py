"""Every query of the library by name, and the SQL it is checked against."""

from __future__ import annotations

from .plans import documents, exports, paged, queries, traces  # noqa: F401

QUERIES: dict = dict(queries.QUERIES)
SQL: dict[str, str] = dict(queries.SQL)
