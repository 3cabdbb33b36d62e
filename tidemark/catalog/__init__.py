"""Registry of queries and their SQL oracles."""

from tidemark.catalog import diagnostics, indicators, inference, jobs, study  # noqa: F401
from tidemark.catalog.registry import ORACLES, QUERIES  # noqa: F401
