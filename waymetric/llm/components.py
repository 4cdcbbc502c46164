"""Connected components of an edge table: the library's rounds of joins, under the operators' column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import network


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between different nodes; component is its least node.  Null ends are no edges."""
    return network.connected_components(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
