"""Registered queries and the SQL they are checked against."""

from benchloom.catalog import evaluation, generation, intake, running  # noqa: F401
from benchloom.catalog.views import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
