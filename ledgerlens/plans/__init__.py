"""Registered queries with their SQL."""

from . import decisions, exits, history, live, metrics, stats, store, windows  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
