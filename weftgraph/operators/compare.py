"""Comparing partitions: pair counts from the contingency table, F1, Gini."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``(c1, c2, n)``: how many vertices each pair of communities shares."""
    joined = truth.select("v", F.col("comm").alias("c1")).join(found.select("v", F.col("comm").alias("c2")), "v")
    return joined.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"))


def _pairs(df: DataFrame, out: str) -> DataFrame:
    n = F.col("n")
    # n (n - 1) / 2 in whole numbers: the even factor is halved before
    pairs = F.shiftright(n, 1) * (F.shiftright(n - 1, 1) * 2 + 1)
    return df.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias(out))


def pair_counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``(tp, fn, fp)`` in time linear in the vertices, not in the pairs."""
    cells = contingency(truth, found)
    same1 = _pairs(cells.groupBy("c1").agg(F.sum("n").alias("n")), "s1")
    same2 = _pairs(cells.groupBy("c2").agg(F.sum("n").alias("n")), "s2")
    row = _pairs(cells, "tp").crossJoin(F.broadcast(same1)).crossJoin(F.broadcast(same2))
    return row.select("tp", (F.col("s1") - F.col("tp")).alias("fn"), (F.col("s2") - F.col("tp")).alias("fp"))


def f1(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``(precision, recall, f1)``; a ratio of nothing is 0."""
    div = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    p = pair_counts(truth, found).select(
        div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")
    )
    both = F.col("precision") + F.col("recall")
    return p.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), both))


def community_counts(assign: DataFrame) -> DataFrame:
    """One row ``(communities, id_range)``: distinct ids, and the largest id plus one."""
    return assign.agg(F.countDistinct("comm").alias("communities"), (F.max("comm") + 1).alias("id_range"))


def gini(sizes: DataFrame) -> DataFrame:
    """One row ``(gini,)`` of the column ``size``.

    Equal sizes share consecutive ranks, so the table is first reduced to
    distinct sizes; the ranks of a run of equal sizes sum in closed form.
    """
    runs = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("hi", upto).withColumn("ranks", (F.col("hi") * (F.col("hi") + 1) - (F.col("hi") - F.col("m")) * (F.col("hi") - F.col("m") + 1)) / 2)
    row = runs.agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("s"), F.sum(F.col("ranks") * F.col("size")).alias("num"))
    value = 2 * F.col("num") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return row.select(F.when(F.col("s") != 0, value).otherwise(0.0).alias("gini"))
