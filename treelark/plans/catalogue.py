"""All registered queries of the engine."""

from treelark.plans import queries_chunk, queries_eval, queries_graph, queries_ingest, queries_search, queries_stream, queries_tree  # noqa: F401
from treelark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
