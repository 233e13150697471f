"""Registered queries."""

from . import checks, folds, games, joins, metrics, scalars, select_queries, stores  # noqa: F401  each registers its own
from . import frames  # noqa: F401, I001  takes the place of queries that the others registered with their SQL
from .flagship import flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
