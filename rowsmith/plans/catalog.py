"""All catalogued queries, by name (importing the query modules registers them)."""

from __future__ import annotations

from rowsmith.plans import q_changes, q_relational, q_reports  # noqa: F401  (import registers the queries)
from rowsmith.plans.registry import REGISTRY, QuerySpec


def all_queries() -> dict[str, QuerySpec]:
    return dict(REGISTRY)
