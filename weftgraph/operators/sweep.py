"""One synchronous Louvain sweep as a relational plan.

All vertices read the same frozen partition, so a sweep has no order and no
races: join neighbour labels, aggregate per (vertex, community), score, and
take the best move of each vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(v, k)``: weighted degree; a stored self-loop row counts once."""
    k = edges.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k"))
    if vertices is None:
        return k
    return vertices.select("v").join(k, "v", "left").select("v", F.coalesce("k", F.lit(0.0)).alias("k"))


def total_weight(edges: DataFrame) -> DataFrame:
    """One row ``(two_m, c)``: the sum over half-edges and its inverse (0 if empty)."""
    two_m = F.coalesce(F.sum("w"), F.lit(0.0))
    return edges.agg(two_m.alias("two_m")).withColumn("c", F.when(F.col("two_m") != 0, 1.0 / F.col("two_m")).otherwise(0.0))


def singletons(vertices: DataFrame) -> DataFrame:
    return vertices.select("v", F.col("v").alias("comm"))


def community_info(assign: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(comm, size, degree)`` of every live community."""
    return assign.join(vertices, "v").groupBy("comm").agg(F.count(F.lit(1)).alias("size"), F.sum("k").alias("degree"))


def neighbor_weights(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """``(v, comm, w_comm, w_loop)``: weight from v into each neighbouring community."""
    labels = assign.select(F.col("v").alias("dst"), "comm")
    loop = F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)
    return (
        edges.join(labels, "dst")
        .groupBy(F.col("src").alias("v"), "comm")
        .agg(F.sum("w").alias("w_comm"), F.sum(loop).alias("w_loop"))
    )


def gains(edges: DataFrame, assign: DataFrame, vertices: DataFrame, c: Column | float, cinfo: DataFrame | None = None) -> DataFrame:
    """``(v, own, comm, gain, own_size, size)`` for every neighbouring community of v but its own.

    A vertex's weight into its own community is one row of the neighbour
    weights, found by (vertex, community); self-loops are all in it. So what
    a hub touches is never gathered in one task: joins on the vertex may be
    split, and the best move is taken by partial aggregates.
    """
    cinfo = community_info(assign, vertices) if cinfo is None else cinfo
    near = neighbor_weights(edges, assign)
    inside = assign.select("v", "comm").join(near, ["v", "comm"], "left").select("v", "comm", F.coalesce(F.col("w_comm") - F.col("w_loop"), F.lit(0.0)).alias("eix"))
    own = (
        inside.join(vertices, "v")
        .join(cinfo, "comm")
        .select("v", F.col("comm").alias("own"), "k", "eix", F.col("size").alias("own_size"), F.col("degree").alias("own_degree"))
    )
    other = cinfo.select("comm", "size", "degree")
    scored = near.join(own, "v").filter("comm <> own").join(other, "comm", "left")
    # a label may outlive its community while the colours of a sweep take turns
    scored = scored.withColumns({"size": F.coalesce("size", F.lit(0)), "degree": F.coalesce("degree", F.lit(0.0))})
    ax = F.col("own_degree") - F.col("k")
    c = F.lit(c) if isinstance(c, float) else c
    gain = 2.0 * (F.col("w_comm") - F.col("eix")) - 2.0 * F.col("k") * (F.col("degree") - ax) * c
    return scored.select("v", "own", "comm", gain.alias("gain"), "own_size", "size")


def best_moves(scored: DataFrame) -> DataFrame:
    """``(v, target, gain)`` of the vertices that move.

    Largest gain above 0, ties to the smaller community. Two singletons never
    swap: the one whose target has the larger id stays.
    """
    best = F.max(F.struct("gain", (-F.col("comm")).alias("neg"), "size", "own", "own_size")).alias("b")
    moves = scored.filter("gain > 0").groupBy("v").agg(best).select("v", (-F.col("b.neg")).alias("target"), "b.gain", "b.size", "b.own", "b.own_size")
    return moves.filter("NOT (size = 1 AND own_size = 1 AND target > own)").select("v", "target", "gain")


def apply_moves(assign: DataFrame, moves: DataFrame) -> DataFrame:
    return assign.join(moves.select("v", "target"), "v", "left").select("v", F.coalesce("target", "comm").alias("comm"))


def sweep(edges: DataFrame, assign: DataFrame, vertices: DataFrame, c: Column | float, cinfo: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """The partition after one sweep. ``active`` (v) restricts which vertices may move."""
    own = edges if active is None else edges.join(active.select(F.col("v").alias("src")), "src", "left_semi")
    return apply_moves(assign, best_moves(gains(own, assign, vertices, c, cinfo)))


def early_termination(current: DataFrame, previous: DataFrame, target: DataFrame, iteration: int) -> DataFrame:
    """``(v, active)``: a vertex with one community through three iterations is frozen."""
    joined = (
        target.select("v", F.col("comm").alias("t"))
        .join(current.select("v", F.col("comm").alias("c")), "v")
        .join(previous.select("v", F.col("comm").alias("p")), "v")
    )
    stable = F.lit(iteration > 2) & (F.col("t") == F.col("c")) & (F.col("c") == F.col("p"))
    return joined.select("v", (~stable).alias("active"))


def decay(state: DataFrame, alpha: float, cutoff: float = 0.02) -> DataFrame:
    """``(v, p, stable)`` to ``(v, p, active)``: p shrinks by 1 - alpha while v is stable."""
    p = F.when(F.col("stable"), F.col("p") * (1.0 - alpha)).otherwise(F.col("p"))
    return state.select("v", p.alias("p"), (p > cutoff).alias("active"))
