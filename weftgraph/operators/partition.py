"""Partition planning and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.prefix import ranged_total


def owner(v: Column, n: int, parts: int) -> Column:
    """The part of v when part j owns ids from floor(n*j/parts)."""
    guess = F.floor(v * parts / n).cast("long")
    start = lambda j: F.floor(j * n / parts)
    # floor(v*parts/n) is one too small where a range starts between ids
    return F.when(start(guess + 1) <= v, guess + 1).otherwise(guess)


def ghost_edges(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """``(part, ghosts)``: half-edges of each part whose other end is elsewhere."""
    mine, other = owner(F.col("src"), n, parts), owner(F.col("dst"), n, parts)
    return edges.groupBy(mine.alias("part")).agg(F.sum((mine != other).cast("long")).alias("ghosts"))


def edge_stats(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """One row of statistics over the edges per part, empty parts included."""
    spark = edges.sparkSession
    counts = edges.groupBy(owner(F.col("src"), n, parts).alias("part")).agg(F.count(F.lit(1)).alias("e"))
    every = spark.range(parts).select(F.col("id").alias("part")).join(counts, "part", "left").select(F.coalesce("e", F.lit(0)).alias("e"))
    e = F.col("e")
    return every.agg(
        F.sum(e).alias("edges"), F.max(e).alias("max_edges"), F.min(e).alias("min_edges"), F.avg(e).alias("avg_edges"),
        F.avg(e * e).alias("avg_square"), F.var_pop(e).alias("variance"), F.stddev_pop(e).alias("stddev"),
    )


def load_summary(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """One row about a graph that is loaded and not clustered: vertices, total weight, and ``edge_stats``."""
    weight = edges.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("two_m"), F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("seen"))
    return edge_stats(edges, n, parts).crossJoin(F.broadcast(weight)).withColumn("vertices", F.greatest(F.lit(n).cast("long"), F.col("seen"))).drop("seen")  # one row each


def balance_edges(edges: DataFrame, vertices: DataFrame, parts: int) -> DataFrame:
    """``(v, part)``: contiguous ranges with about equal numbers of half-edges.

    By the running degree: part = floor((edges before v) / ceil(edges/parts)).
    A range may therefore differ by a vertex from the greedy fill, which needs
    one sequential pass.
    """
    deg = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    every = vertices.join(deg, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    run = ranged_total(every, [F.col("v")], F.col("n"), "upto")
    total = edges.agg(F.greatest(F.ceil(F.count(F.lit(1)) / parts), F.lit(1)).alias("cap"))
    part = F.least(F.lit(parts - 1), F.floor((F.col("upto") - F.col("n")) / F.col("cap")))
    return run.crossJoin(F.broadcast(total)).select("v", part.cast("long").alias("part"))


def greedy_bins(edges: DataFrame, vertices: DataFrame, parts: int) -> list[int]:
    """Range starts of the exact greedy fill, by one streamed pass on the driver.

    Takes the vertex degrees one partition at a time, so memory is bounded by
    a partition; use :func:`balance_edges` for anything large.
    """
    deg = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = vertices.join(deg, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n")).orderBy("v")
    cap, starts, load = edges.count() // parts, [0], 0
    for i, row in enumerate(rows.toLocalIterator()):
        load += row.n
        if load >= cap and len(starts) < parts:
            starts.append(i + 1)
            load = 0
    return starts
