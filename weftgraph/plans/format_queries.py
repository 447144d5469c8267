"""Each reader and sink on a file that is written from the tables, and SQL for what must be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import build, compare
from weftgraph.plans import derive
from weftgraph.plans.catalogue import COPURCHASE, ENDS, PARTITIONS, RAW, rounded
from weftgraph.plans.registry import SQL, query
from weftgraph.plans.stage import new_path
from weftgraph.sources import text


def written(rows: DataFrame, line: Column, order: list[str], head: tuple[str, ...] = ()) -> str:
    """A folder of part files that follow each other: ``head``, then a line a row along ``order``."""
    path = new_path(rows.sparkSession, "lines")
    body = rows.select(F.struct(F.lit(len(head)).alias("__n"), *order).alias("at"), line.alias("value"))
    if head:
        first = F.struct(F.col("__n"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order))
        body = rows.sparkSession.createDataFrame(list(enumerate(head)), "__n int, value string").select(first.alias("at"), "value").unionByName(body)
    body.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    return path


def lines(spark: SparkSession, d: str) -> DataFrame:
    return derive.customer_supplier_lines(spark, d)


ORDER = ["ord", "line", "dst", "src", "w"]  # order lines are not numbered uniquely
BOTH = f"WITH {RAW} SELECT src, dst, w FROM raw UNION ALL SELECT dst, src, w FROM raw"


@query(BOTH)
def read_edge_list_directed(spark, d):
    path = written(lines(spark, d), F.concat_ws(" ", "src", "dst", "w"), ORDER)
    return text.read_edge_list(spark, path)


@query(BOTH)
def read_edge_list_undirected(spark, d):
    edges = build.symmetrize(lines(spark, d).select("src", "dst", "w"))
    path = written(edges, F.concat_ws("\t", F.col("src") + 1, F.col("dst") + 1, "w"), ["src", "dst", "w"])
    return text.read_edge_list(spark, path, directed=False, base=1)


@query(SQL["edges_evalue_cutoff"])
def read_evalue_tsv(spark, d):
    path = written(lines(spark, d), F.concat_ws("\t", F.concat(F.lit("c"), "src"), F.concat(F.lit("s"), "dst"), "e"), ORDER)
    return text.read_evalue(spark, path, 0.03)[0]


FIRST_SEEN = f"""WITH {RAW}, ends AS ({ENDS}), firsts AS (SELECT old_id, min((ord, line, dst, side)) AS seen FROM ends GROUP BY 1),
    ids AS (SELECT old_id, row_number() OVER (ORDER BY seen) - 1 AS id FROM firsts), e AS (SELECT a.id AS src, b.id AS dst FROM raw JOIN ids a ON a.old_id = src JOIN ids b ON b.old_id = dst)"""


@query(f"{FIRST_SEEN} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM e UNION ALL SELECT dst, src, 1 FROM e")
def read_snap(spark, d):
    path = written(lines(spark, d), F.concat_ws("\t", "src", "dst"), ORDER, ("# Nodes: 1 Edges: 1",))
    return text.read_snap(spark, path)[0]


DIMACS = f"""WITH {RAW}, both_ways AS (SELECT ord, line, 0 AS side, src, dst, w FROM raw UNION ALL SELECT ord, line, 1, dst, src, w FROM raw)
    SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord, line, w, side) AS r FROM both_ways)"""


def _arcs(spark, d):
    return written(lines(spark, d), F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, "w"), ORDER, ("c a comment", "p sp 1 1"))


@query(f"{DIMACS} WHERE r = 1")
def read_dimacs_directed(spark, d):
    return text.read_dimacs(spark, _arcs(spark, d))


@query(f"{DIMACS} WHERE r = 1 AND side = 0")
def read_dimacs_given(spark, d):
    return text.read_dimacs(spark, _arcs(spark, d), directed=False)


@query(f"WITH {COPURCHASE} SELECT src, dst, w FROM edges")
def read_metis(spark, d):
    edges = derive.copurchase(spark, d)
    items = F.array_join(F.flatten(F.collect_list(F.array((F.col("dst") + 1).cast("string"), F.col("w").cast("long").cast("string")))), " ")
    listed = edges.groupBy(F.col("src").alias("v")).agg(items.alias("items"))
    every = spark.range(edges.agg(F.max("src") + 1).first()[0]).select(F.col("id").alias("v")).join(listed, "v", "left")
    return text.read_metis(spark, written(every, F.coalesce("items", F.lit("")), ["v"], ("% a comment", "1 1 1")))


@query(f"WITH {COPURCHASE} SELECT src, dst, w FROM edges")
def read_matrix_symmetric(spark, d):
    path = written(derive.copurchase_pairs(spark, d), F.concat_ws(" ", F.col("dst") + 1, F.col("src") + 1, "w"), ["dst", "src"], ("%%MatrixMarket matrix coordinate real symmetric", "% c", "1 1 1"))
    return text.read_matrix_market(spark, path)


@query(f"WITH {COPURCHASE} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM pairs")
def read_matrix_pattern(spark, d):
    path = written(derive.copurchase_pairs(spark, d), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1), ["src", "dst"], ("%%MatrixMarket matrix coordinate pattern general", "1 1 1"))
    return text.read_matrix_market(spark, path)


COMPACT = "ids AS (SELECT old_id, row_number() OVER (ORDER BY old_id) - 1 AS new_id FROM (SELECT src AS old_id FROM {t} UNION SELECT dst FROM {t}))"


@query(
    f"""WITH {RAW}, {COMPACT.format(t='raw')}, e AS (SELECT DISTINCT a.new_id AS src, b.new_id AS dst FROM raw JOIN ids a ON a.old_id = src JOIN ids b ON b.old_id = dst)
    SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM e UNION ALL SELECT dst, src, 1 FROM e"""
)
def read_pajek(spark, d):
    path = written(lines(spark, d), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1), ORDER, ("*Vertices 2000000", "*Edges"))
    return text.read_pajek(spark, path)[0]


def _shards(spark, d):
    """Three files of pairs between two halves of the vertices, and the size of a half."""
    pairs, path = derive.copurchase_pairs(spark, d), new_path(spark, "shards")
    half = (pairs.agg(F.max("dst")).first()[0] + 2) // 2
    shard = lambda c: F.floor(F.col(c) / half) + 1
    for i, j in ((1, 1), (1, 2), (2, 2)):
        rows = pairs.filter((shard("src") == i) & (shard("dst") == j)).select((F.col("src") % half).alias("ai"), (F.col("dst") % half).alias("aj"), F.lit(0.0).alias("common"), F.col("w").alias("jaccard"))
        rows.write.option("header", True).csv(f"{path}/{i}__{j}.csv")
    return path, half


@query(f"WITH {COPURCHASE}, {COMPACT.format(t='edges')} SELECT a.new_id AS src, b.new_id AS dst, w FROM edges JOIN ids a ON a.old_id = src JOIN ids b ON b.old_id = dst")
def read_shards(spark, d):
    path, half = _shards(spark, d)
    return text.read_shards(spark, path, 1, 2, half)[0]


@query(f"WITH {COPURCHASE} SELECT src, dst, w FROM edges")
def read_shards_sparse(spark, d):
    path, half = _shards(spark, d)
    return text.read_shards(spark, path, 1, 2, half, compact=False)[0]


@query(SQL["compare_f1"])
def compare_truth_file(spark, d):
    path = written(derive.embedding_truth(spark, d), F.concat_ws(" ", "v", F.col("comm") + 1), ["v"])
    return rounded(compare.f1(text.read_ground_truth(spark, path, base=1), derive.embedding_found(spark, d)), "precision", "recall", "f1")


@query(f"WITH {PARTITIONS} SELECT row_number() OVER (ORDER BY v) - 1 AS line_no, CAST(comm AS VARCHAR) AS value FROM found")
def write_communities(spark, d):
    path = new_path(spark, "communities")
    text.write_communities(derive.embedding_found(spark, d), path)
    return text.numbered_lines(spark, path)


@query(f"WITH {RAW}, {COMPACT.format(t='raw')} SELECT old_id, new_id FROM ids")
def write_mapping(spark, d):
    path = new_path(spark, "mapping")
    text.write_mapping(build.compact(lines(spark, d)), path)
    pair = F.split("value", " ")
    return spark.read.text(path).select(pair[0].cast("long").alias("old_id"), pair[1].cast("long").alias("new_id"))

