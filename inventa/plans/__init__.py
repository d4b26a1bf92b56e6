"""Named queries over the provided tables (one module per area)."""

from inventa.plans import arrays, checks, columns, dispatch, ingest, members, phases, results, runs, silver_tables  # noqa: F401
from inventa.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
