"""All queries over the test tables, with their DuckDB counterparts."""

from __future__ import annotations

from tidewater.plans import cohort, files, fits, learners, learning, series, sets, tests  # noqa: F401  register their queries
from tidewater.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
