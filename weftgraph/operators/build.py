"""From records to half-edges: symmetrise, weight policies, numbering, CSR offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashing import uniform
from weftgraph.functions.prefix import dense_ids, ranged_total

POLICIES = ("original", "abs", "one", "random")


def symmetrize(edges: DataFrame, selfloops: str = "twice") -> DataFrame:
    """Both directions of every edge.

    ``selfloops="twice"`` stores a self-loop as two rows (edge lists, SNAP,
    DIMACS); ``"once"`` keeps one row (symmetric matrices, shards).
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    if selfloops == "once":
        back = back.filter("src <> dst")
    return edges.select("src", "dst", "w").unionByName(back)


def weight(policy: str, raw: Column | None, src: Column, dst: Column, seed: int = 0) -> Column:
    """The weight under a policy; a missing weight is 1.0.

    Random weights are uniform in [0.01, 1) and depend on the unordered pair,
    so both half-edges agree.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown weight policy {policy!r}")
    if policy == "one":
        return F.lit(1.0)
    if policy == "random":
        return uniform(seed, F.least(src, dst), F.greatest(src, dst), low=0.01, high=1.0)
    value = F.coalesce(raw.cast("double"), F.lit(1.0)) if raw is not None else F.lit(1.0)
    return F.abs(value) if policy == "abs" else value


def drop_selfloops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def dedup_first(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row a (src, dst): the first along ``order``. One partial aggregate, no sort."""
    first = F.min(F.struct(*order, "w")).alias("f")
    return edges.groupBy("src", "dst").agg(first).select("src", "dst", F.col("f.w").alias("w"))


def first_seen(edges: DataFrame, order: list[str]) -> DataFrame:
    """``(old_id, new_id)``: ids numbered by first appearance, src before dst on a line."""
    ends = edges.select(F.struct(*order, F.lit(0).alias("side")).alias("at"), F.col("src").alias("old_id")).unionByName(
        edges.select(F.struct(*order, F.lit(1).alias("side")).alias("at"), F.col("dst").alias("old_id"))
    )
    firsts = ends.groupBy("old_id").agg(F.min("at").alias("at"))
    out = ranged_total(firsts, [F.col("at")], F.lit(1), "new_id")
    return out.select("old_id", (F.col("new_id").cast("long") - 1).alias("new_id"))


def compact(edges: DataFrame) -> DataFrame:
    """``(old_id, new_id)``: the ids that occur, numbered in ascending order without gaps."""
    ids = edges.select(F.col("src").alias("old_id")).unionByName(edges.select(F.col("dst").alias("old_id"))).distinct()
    return dense_ids(ids, "old_id", "new_id")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    a = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("s"))
    b = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()


def csr_offsets(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(v, offset)``: the number of half-edges of all smaller vertices."""
    deg = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if vertices is not None:
        deg = vertices.join(deg, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    out = ranged_total(deg, [F.col("v")], F.col("n"), "upto")
    return out.select("v", (F.col("upto") - F.col("n")).cast("long").alias("offset"))


def csr_rows(edges: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``(v, part, tails, weights)``: adjacency lists sorted by tail.

    The list of a vertex is cut where tails pass a multiple of ``span``, so no
    row holds more than that many neighbours, however large a hub; its parts
    by ascending ``part`` are the whole list.
    """
    pairs = F.array_sort(F.collect_list(F.struct("dst", "w")))
    adj = edges.groupBy(F.col("src").alias("v"), F.floor(F.col("dst") / F.lit(span)).alias("part")).agg(pairs.alias("a"))
    return adj.select("v", "part", F.col("a.dst").alias("tails"), F.col("a.w").alias("weights"))


