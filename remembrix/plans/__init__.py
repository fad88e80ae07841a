from . import records, retrieval
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "records", "retrieval"]
