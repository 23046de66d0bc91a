"""All queries of the engine and their SQL."""

from __future__ import annotations

from chronolith.plans import analysis, corpus, extra, files, more, rest, streams, study  # noqa: F401  each registers its queries
from chronolith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
