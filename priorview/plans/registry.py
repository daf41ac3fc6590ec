"""Imports every query module, so that the catalog is full."""

from . import scorecard_queries, history_queries, resolve_queries, request_queries, estimate_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
