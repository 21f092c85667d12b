"""The engine's queries by name, and SQL for those that SQL can express."""

from . import lifecycle as lifecycle
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
