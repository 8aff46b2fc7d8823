"""Registered queries and their SQL."""

from . import aggregates, events, ops, search, snapshots, stores, sync, views  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
