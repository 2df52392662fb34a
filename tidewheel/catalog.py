"""Name -> query, and name -> the same query in SQL."""

from __future__ import annotations

from tidewheel.plans import records  # noqa: F401  registers its queries
from tidewheel.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
