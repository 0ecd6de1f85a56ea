"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from larkstream.plans import workspace_queries  # noqa: F401  (registers its queries)
from larkstream.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
