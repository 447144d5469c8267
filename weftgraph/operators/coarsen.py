"""The next level: renumber communities, contract the graph, fold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.prefix import dense_ids


def renumber(assign: DataFrame) -> DataFrame:
    """``(comm, new_comm)``: live communities numbered by their smallest vertex."""
    firsts = assign.groupBy("comm").agg(F.min("v").alias("first"))
    return dense_ids(firsts, "first", "new_comm").select("comm", "new_comm")


def relabel(assign: DataFrame) -> DataFrame:
    """The same partition with communities 0 .. k-1."""
    return assign.join(renumber(assign), "comm").select("v", F.col("new_comm").alias("comm"))


def relabel_sorted(assign: DataFrame) -> DataFrame:
    """Communities 0 .. k-1 in the order of their ids."""
    ids = dense_ids(assign.select("comm").distinct(), "comm", "new_comm")
    return assign.join(ids, "comm").select("v", F.col("new_comm").alias("comm"))


def coarsen(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Contracted half-edges; weight inside a community becomes its self-loop.

    ``assign`` is expected to carry the new numbering already (``relabel``).
    """
    a = assign.select(F.col("v").alias("src"), F.col("comm").alias("cs"))
    b = assign.select(F.col("v").alias("dst"), F.col("comm").alias("cd"))
    # Sum parallel edges once an end is renamed: less to shuffle for the second.
    half = edges.join(a, "src").groupBy("cs", "dst").agg(F.sum("w").alias("w"))
    return half.join(b, "dst").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w"))


def fold(base: DataFrame, level: DataFrame) -> DataFrame:
    """Labels of the original vertices after one more level."""
    up = level.select(F.col("v").alias("comm"), F.col("comm").alias("up"))
    return base.join(up, "comm").select("v", F.col("up").alias("comm"))
