"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import connected_components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, root); root is the smallest node of the component.

    Only nodes that have an edge are returned. Neighbour minima are aggregates with a
    map-side part, and edges meet them in plain equi-joins, so a hub is never gathered.
    """
    return connected_components(edges, "a", "b", max_rounds).withColumnRenamed("component", "root")
