"""The queries of this subpackage."""

from siltstone.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
