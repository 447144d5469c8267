"""Graphs derived from ordinary tables, as half-edges or as raw records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.build import symmetrize
from weftgraph.plans.laid import Halves, Source, merged

LINES = 1 << 18  # order lines paired at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _together(lines: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of ``key`` values that occur in one order, w = orders."""
    op = lines.select("l_orderkey", key).distinct()
    a = op.select("l_orderkey", F.col(key).alias("src"))
    b = op.select("l_orderkey", F.col(key).alias("dst"))
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(table(spark, sf_dir, "lineitem"), "l_partkey")


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrize(copurchase_pairs(spark, sf_dir))


def _pairs(keys: np.ndarray, values: np.ndarray) -> Iterator[Halves]:
    """Both directions of the pairs of distinct values of a key."""
    keys, values, _ = merged(keys, values, None)
    at, step = np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        a, b = values[at], values[at + step]
        yield np.concatenate([a, b]), np.concatenate([b, a]), None
        step += 1


def _paired(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Halves]:
    """Pairs of rows ``(key, value)`` that come by ascending key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, most = 0, least
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= most:
            keys, values = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield from _pairs(keys[:cut], values[:cut])
            held, rows = [(keys[cut:], values[cut:])], len(keys) - cut
            most = max(least, 2 * rows)
    if rows:
        yield from _pairs(*[np.concatenate(x) for x in zip(*held)])


def copurchase_source(spark: SparkSession, sf_dir: str) -> Source:
    """The half-edges of ``copurchase``, made by tasks."""
    lines = table(spark, sf_dir, "lineitem").select(*[F.col(x).cast("long").alias(x) for x in ("l_orderkey", "l_partkey")])
    return Source(lines.dropna(), "l_orderkey", partial(_paired, least=LINES))


def cosupplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrize(_together(table(spark, sf_dir, "lineitem"), "l_suppkey"))


def customer_supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw directed records ``(ord, line, src, dst, w)``: customer to supplier, one an order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("src"),
        (F.col("l_suppkey") + 1_000_000).alias("dst"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("e"),
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("v"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def embedding_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").cast("long").alias("comm"))


def embedding_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple partition of the vectors: by the signs of four components."""
    e = F.col("embedding")
    code = sum((e[i] > 0).cast("long") * (1 << i) for i in range(4))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), code.alias("comm"))
