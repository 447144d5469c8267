"""Prefix sums and dense numbering that no single task computes alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.stage import materialize


def running_total(
    df: DataFrame, bucket: Column, order: Sequence[Column], value: Column, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to and with each row.

    ``bucket`` must not decrease along ``order`` (it may be null-free only).
    Buckets are summed first; the running sums of the bucket totals, one row a
    bucket, are joined back and the rest is a window within a bucket. ``by``
    restarts the sum for each combination of those columns.
    """
    df = df.withColumn("__b", bucket).withColumn("__x", value)
    keys = [*by, "__b"]
    totals = df.groupBy(*keys).agg(F.sum("__x").alias("__t"))
    w = Window.partitionBy(*by).orderBy("__b") if by else Window.orderBy("__b")
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if by:  # keys may be null
        left, right = df.alias("l"), before.alias("r")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        joined = left.join(right, on).select("l.*", "r.__before")
    else:
        joined = df.join(before.select("__b", "__before"), "__b")
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("__before") + F.sum("__x").over(inner)).drop("__b", "__x", "__before")


def by_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with the number ``__b`` of the range along ``order`` that each row lies in.

    Ranges are cut where the rows are, so they hold about equally many however
    sparse or clustered the keys; equal keys share one. They are written, so
    that a number stays what it is when a lost task is run again.
    """
    return materialize(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "ranges")


def ranged_total(df: DataFrame, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the running sum of ``value`` along ``order``. Only one row a range meets in one task."""
    return running_total(by_ranges(df, order), F.col("__b"), order, value, out)


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number the rows of a table with distinct ``key`` 0, 1, … along it."""
    return ranged_total(df, [F.col(key)], F.lit(1), out).withColumn(out, F.col(out).cast("long") - 1)
