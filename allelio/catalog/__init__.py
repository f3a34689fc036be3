"""All registered queries and their oracles."""

from allelio.catalog import analyses, columns, relations, sources  # noqa: F401
from allelio.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
