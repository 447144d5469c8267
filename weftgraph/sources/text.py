"""Readers of graph text formats: every one returns half-edges ``(src, dst, w)``.

Lines are parsed by column expressions. Where the order of lines matters (first
seen, first wins, line i is vertex i) each line gets its number from its file
block and its place in it, so splitting a file over executors changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.prefix import running_total
from weftgraph.operators import build

COMMENT = "^[#%]"
# Fixed values of the matrix banner.
FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of the files under ``path``, numbered from 0 by file and place.

    Only one row a file block meets in one task.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    )
    counts = raw.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row a file block
    before = counts.select("f", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("f", "b").orderBy("i")) - 1
    return raw.withColumn("place", place).join(before, ["f", "b"]).select((F.col("before") + F.col("place")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def _tokens(value: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(value, "[\\s]+", " ")), " ")


def _records(lines: DataFrame, comment: str = COMMENT) -> DataFrame:
    text = F.trim(F.col("value"))
    return lines.filter((F.length(text) > 0) & ~text.rlike(comment)).withColumn("t", _tokens(F.col("value")))


def _edge(rows: DataFrame, base: int, policy: str, seed: int, keep: tuple[str, ...] = (), at: int = 0) -> DataFrame:
    src, dst = F.get("t", F.lit(at)).cast("long") - base, F.get("t", F.lit(at + 1)).cast("long") - base
    rows = rows.select(*keep, src.alias("src"), dst.alias("dst"), F.get("t", F.lit(at + 2)).cast("double").alias("raw"))
    return rows.select(*keep, "src", "dst", build.weight(policy, F.col("raw"), F.col("src"), F.col("dst"), seed).alias("w"))


def read_edge_list(spark: SparkSession, path: str, directed: bool = True, base: int = 0, policy: str = "abs", seed: int = 0) -> DataFrame:
    """``u v [w]`` with # or % comments; a missing weight is 1.

    ``directed`` files list each edge once and get both directions (a
    self-loop is then stored twice); otherwise both directions are in the
    file. Nothing is deduplicated, blank lines are skipped.
    """
    edges = _edge(_records(spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))), base, policy, seed)
    return build.symmetrize(edges) if directed else edges


def read_evalue(spark: SparkSession, path: str, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """``key1 key2 e``: edges with e <= cutoff in both directions, and ``(key, id)`` in first-seen order.

    Ids are given over both columns, to the kept lines only.
    """
    rows = _records(numbered_lines(spark, path), "^#").select(
        "line_no", F.get("t", F.lit(0)).alias("src"), F.get("t", F.lit(1)).alias("dst"), F.get("t", F.lit(2)).cast("double").alias("w")
    )
    kept = rows.filter(F.col("w") <= cutoff)
    ids = build.first_seen(kept, ["line_no"])
    edges = build.relabel(kept.select("src", "dst", "w"), ids)
    return build.symmetrize(edges), ids.select(F.col("old_id").alias("key"), F.col("new_id").alias("id"))


def read_snap(spark: SparkSession, path: str, policy: str = "one", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``u v`` with # comments: ids renumbered by first appearance, both directions; and the mapping."""
    rows = _edge(_records(numbered_lines(spark, path)), 0, policy, seed, ("line_no",))
    ids = build.first_seen(rows, ["line_no"])
    return build.symmetrize(build.relabel(rows, ids)), ids


def snap_header(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The (nodes, edges) that the header claims."""
    pattern = "Nodes:\\s*(\\d+)\\s+Edges:\\s*(\\d+)"
    row = spark.read.text(path).filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1), F.regexp_extract("value", pattern, 2)).first()
    return (int(row[0]), int(row[1])) if row else None


def read_dimacs(spark: SparkSession, path: str, directed: bool = True, policy: str = "abs", seed: int = 0) -> DataFrame:
    """``c`` comments, ``p sp n m``, ``a u v w``, ids from 1. Of equal (u, v) the first line wins.

    ``directed`` stores both directions, otherwise the file's.
    """
    arcs = _records(numbered_lines(spark, path), "^[cp#%]").filter(F.get("t", F.lit(0)) == "a")
    edges = _edge(arcs, 1, policy, seed, ("line_no",), at=1)
    if directed:
        back = edges.select("line_no", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        edges = edges.withColumn("d", F.lit(0)).unionByName(back.withColumn("d", F.lit(1)))
        return build.dedup_first(edges, ["line_no", "d"])
    return build.dedup_first(edges, ["line_no"])


def read_metis(spark: SparkSession, path: str, policy: str = "abs", seed: int = 0) -> DataFrame:
    """Header ``n m [fmt [ncon]]``, then line i: the neighbours of vertex i, from 1.

    fmt 1 and 11 have edge weights; 10 and 11 vertex weights (skipped). A blank
    line is a vertex without neighbours.
    """
    lines = numbered_lines(spark, path).filter(~F.trim("value").rlike("^[%#]"))
    first = lines.agg(F.min("line_no")).first()[0]
    if first is None:
        return spark.createDataFrame([], "src long, dst long, w double")
    head = lines.filter(F.col("line_no") == first).first()["value"].split()
    fmt = head[2].zfill(3) if len(head) > 2 else "000"
    weighted, skip = fmt[-1] == "1", int(head[3]) if len(head) > 3 else int(fmt[-2] == "1")
    body = lines.filter(F.col("line_no") > first)
    # comments inside the body do not count as vertices
    order = body.select(F.col("line_no").alias("k"), "value")
    rows = running_total(order, F.floor(F.col("k") / F.lit(1 << 16)), [F.col("k")], F.lit(1), "vertex")
    rows = rows.select((F.col("vertex") - 1).cast("long").alias("src"), _tokens(F.col("value")).alias("t")).filter(F.get("t", F.lit(0)) != "")
    items = rows.select("src", F.posexplode(F.slice("t", skip + 1, F.greatest(F.size("t") - skip, F.lit(0)))).alias("pos", "tok"))
    if not weighted:
        edges = items.select("src", (F.col("tok").cast("long") - 1).alias("dst"), F.lit(None).cast("double").alias("raw"))
    else:
        both = items.groupBy("src", F.floor(F.col("pos") / 2).alias("pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("tok"))).alias("d"), F.max(F.when(F.col("pos") % 2 == 1, F.col("tok"))).alias("raw"))
        edges = both.select("src", (F.col("d").cast("long") - 1).alias("dst"), F.col("raw").cast("double").alias("raw"))
    return edges.select("src", "dst", build.weight(policy, F.col("raw"), F.col("src"), F.col("dst"), seed).alias("w"))


def read_matrix_market(spark: SparkSession, path: str, policy: str = "original", symmetrize: bool = False, seed: int = 0) -> DataFrame:
    """Coordinate matrices, ids from 1. Symmetric ones are mirrored off the diagonal, general ones stay as given.

    Pattern entries weigh 1, complex entries their real part.
    """
    lines = numbered_lines(spark, path)
    head = lines.filter("line_no = 0").first()
    words = head["value"].lower().split() if head else []
    if len(words) < 5 or words[0] != "%%matrixmarket" or words[1:3] != ["matrix", "coordinate"] or words[3] not in FIELDS or words[4] not in SYMMETRIES:
        raise ValueError("not a supported matrix banner")
    rows = _records(lines.filter("line_no > 0"), "^%")
    size_at = rows.agg(F.min("line_no")).first()[0]
    edges = _edge(rows.filter(F.col("line_no") > (size_at if size_at is not None else -1)), 1, "one" if words[3] == "pattern" and policy in ("original", "abs") else policy, seed)
    return build.symmetrize(edges, "once") if words[4] == "symmetric" or symmetrize else edges


def read_pajek(spark: SparkSession, path: str, seed: int = 0, policy: str = "one") -> tuple[DataFrame, DataFrame]:
    """``*Vertices n`` then ``u v``, ids from 1: mirrored, deduplicated, isolated ids dropped.

    Returns half-edges over compact ids, and the mapping ``(old_id, new_id)``.
    """
    lines = numbered_lines(spark, path)
    head = lines.filter(F.lower(F.trim("value")).startswith("*vertices")).first()
    if head is None:
        raise ValueError("no *Vertices line")
    n = int(head["value"].split()[1])
    rows = _records(lines, "^[%*]")
    edges = _edge(rows, 1, policy, seed, ("line_no",)).filter((F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n))
    both = build.symmetrize(edges.select("src", "dst", "w")).groupBy("src", "dst").agg(F.min("w").alias("w"))
    ids = build.compact(both)
    return build.relabel(both, ids), ids


def read_shards(spark: SparkSession, path: str, start: int, end: int, count: int, compact: bool = True, policy: str = "original", seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Files, or folders of part files, ``<i>__<j>.csv`` of ``ai,aj,common,jaccard`` with start <= i, j <= end.

    Ids are offset by (i-1)*count and (j-1)*count; edges are mirrored with a
    self-loop stored once. With ``compact`` ids are renumbered without gaps and
    the mapping is returned as well.
    """
    raw = spark.read.schema("ai long, aj long, common double, jaccard double").option("header", True).csv(f"{path}/*__*.csv")
    part = lambda i: F.regexp_extract(F.input_file_name(), "([0-9]+)__([0-9]+)\\.csv(?:/part-[^/]*)?$", i).cast("long")
    rows = raw.withColumns({"i": part(1), "j": part(2)})
    rows = rows.filter(F.col("i").between(start, end) & F.col("j").between(start, end))
    src, dst = F.col("ai") + (F.col("i") - 1) * count, F.col("aj") + (F.col("j") - 1) * count
    edges = rows.select(src.alias("src"), dst.alias("dst"), F.col("jaccard").alias("raw")).filter(src.isNotNull() & dst.isNotNull())
    both = build.symmetrize(edges.select("src", "dst", build.weight(policy, F.col("raw"), F.col("src"), F.col("dst"), seed).alias("w")), "once")
    if not compact:
        return both, None
    ids = build.compact(both)
    return build.relabel(both, ids), ids


def read_ground_truth(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """``v comm`` a line; community ids from ``base``. Joined by vertex id, not by place."""
    rows = _records(spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")))
    return rows.select(F.get("t", F.lit(0)).cast("long").alias("v"), (F.get("t", F.lit(1)).cast("long") - base).alias("comm"))


def write_communities(assign: DataFrame, path: str) -> None:
    """One community a line, line v is vertex v, in part files that follow each other."""
    assign.repartitionByRange("v").sortWithinPartitions("v").select(F.col("comm").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """``old new`` a line, ordered by old id."""
    ordered = mapping.repartitionByRange("old_id").sortWithinPartitions("old_id")
    ordered.select(F.concat_ws(" ", F.col("old_id").cast("string"), F.col("new_id").cast("string")).alias("value")).write.mode("overwrite").text(path)
