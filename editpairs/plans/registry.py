"""All registered queries of the edit-pair operators."""

from __future__ import annotations

from editpairs.plans import file_queries, pixel_queries, queries  # noqa: F401  each registers its own

QUERIES, SQL = queries.QUERIES, queries.SQL
