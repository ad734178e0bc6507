"""Registered queries over the given tables, each beside the SQL that must give the same rows."""

from panelkit.queries import census, panels, publications, stats, sums, tables  # noqa: F401  (they register)
from panelkit.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
