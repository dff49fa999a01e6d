"""All registered queries."""

from __future__ import annotations

from vecspark.plans import cluster_queries, graph_queries, knn_queries, metric_queries, pq_queries, source_queries
from vecspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "cluster_queries", "graph_queries", "knn_queries", "metric_queries", "pq_queries", "source_queries"]
