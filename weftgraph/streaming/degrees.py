"""Weighted degrees kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """``(v, k)`` of a streaming frame of undirected edges; use output mode update or complete.

    The state holds one double a vertex, partitioned by vertex.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("v")), F.struct(F.col("dst").alias("v")))).alias("end")
    return edges.select(ends, "w").groupBy(F.col("end.v").alias("v")).agg(F.sum("w").alias("k"))
