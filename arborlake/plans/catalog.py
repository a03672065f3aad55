"""The store queries of the driver contract and their SQL oracles."""

from arborlake.plans import codec_queries, graph_queries, record_queries, ref_queries, scalar_queries, tree_queries  # noqa: F401  they register their queries
from arborlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
