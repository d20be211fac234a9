from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
