"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from profilis.plans import activity_queries, behaviour_queries, feature_queries, profile_queries, rendering_queries  # noqa: F401
from profilis.plans.registry import ORACLES, QUERIES  # noqa: F401
