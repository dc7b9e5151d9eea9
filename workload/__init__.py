"""Queries over chat data derived from the given tables, with SQL oracles."""

from . import catalog_joins, catalog_scans, catalog_streams, catalog_views  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
