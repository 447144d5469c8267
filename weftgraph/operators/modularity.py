"""Modularity of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.sweep import community_info, degrees, total_weight


def internal_weight(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row ``(e_in,)``: weight of the half-edges inside communities."""
    a = assign.select(F.col("v").alias("src"), F.col("comm").alias("cs"))
    b = assign.select(F.col("v").alias("dst"), F.col("comm").alias("cd"))
    inside = edges.join(a, "src").join(b, "dst").filter("cs = cd")
    return inside.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("e_in"))


def internal_by_vertex(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """``(v, e)``: the weight of each vertex into its own community, where there is any."""
    a = assign.select(F.col("v").alias("src"), F.col("comm").alias("cs"))
    b = assign.select(F.col("v").alias("dst"), F.col("comm").alias("cd"))
    return edges.join(a, "src").join(b, "dst").filter("cs = cd").groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("e"))


def replayed_modularity(held: DataFrame, after: DataFrame, vertices: DataFrame, total: DataFrame) -> DataFrame:
    """One row ``(q,)``: the lagged figure with an edge term that is given by vertex (``v, e``)."""
    squares = community_info(after, vertices).agg(F.coalesce(F.sum(F.col("degree") * F.col("degree")), F.lit(0.0)).alias("a2"))
    terms = held.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e_in")).crossJoin(F.broadcast(squares)).crossJoin(F.broadcast(total))  # one row each
    return terms.select(F.abs(F.col("e_in") * F.col("c") - F.col("a2") * F.col("c") * F.col("c")).alias("q"))


def lagged_modularity(edges: DataFrame, before: DataFrame, after: DataFrame, vertices: DataFrame | None = None, absolute: bool = False) -> DataFrame:
    """One row ``(q,)``: edge term of one partition, degree term of the next.

    This is the figure that a sweep-by-sweep implementation reports; with both
    partitions equal it is the true modularity.
    """
    vertices = degrees(edges) if vertices is None else vertices
    squares = community_info(after, vertices).agg(F.coalesce(F.sum(F.col("degree") * F.col("degree")), F.lit(0.0)).alias("a2"))
    terms = internal_weight(edges, before).crossJoin(F.broadcast(squares)).crossJoin(F.broadcast(total_weight(edges)))
    q = F.col("e_in") * F.col("c") - F.col("a2") * F.col("c") * F.col("c")
    return terms.select((F.abs(q) if absolute else q).alias("q"))


def modularity(edges: DataFrame, assign: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One row ``(q,)``: the true modularity of one partition."""
    return lagged_modularity(edges, assign, assign, vertices)
