"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from quantloom.plans import pipeline, reference, skew  # noqa: F401  (pipeline adds to the queries of reference)

QUERIES = {**skew.QUERIES, **reference.QUERIES}
ORACLES = {**skew.ORACLES, **reference.ORACLES}
