"""Named queries over the test tables, each with the SQL that gives the same rows."""

from . import alerting, correlation, lookups, parsing, scalars, sources_sinks, stores, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
