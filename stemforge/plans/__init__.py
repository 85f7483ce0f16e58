"""Registered queries over the driver tables, each with an independent SQL statement of its result."""

from . import family_queries, graph_queries, index_queries, lexicon_queries, numeric_queries, relation_queries, table_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "family_queries", "graph_queries", "index_queries", "lexicon_queries", "numeric_queries", "relation_queries", "table_queries"]
