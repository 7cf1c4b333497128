"""The queries that the driver runs, by name, and the SQL that each is held against."""

from __future__ import annotations

from . import image_queries, kernel_queries

QUERIES = image_queries.QUERIES | kernel_queries.QUERIES
ORACLES = image_queries.ORACLES | kernel_queries.ORACLES
