"""Distance-1 colouring by several independent-set hashes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashing import SEED, SEED_STEP, mix32, mix32_py
from weftgraph.plans.stage import materialize

COVERAGE = 0.7


def hash_values(vertices: DataFrame, n_hash: int = 4, seed: int = SEED) -> DataFrame:
    return vertices.select("v", *[mix32(F.col("v"), seed + SEED_STEP * t).alias(f"h{t}") for t in range(n_hash)])


def color_round(edges: DataFrame, colors: DataFrame, n_hash: int, next_color: int, seed: int) -> DataFrame:
    """Colour what can be coloured in one round; ``colors`` is (v, color or null).

    A vertex may take slot 2t if it is a strict minimum and 2t+1 if a strict
    maximum of hash t among its uncoloured neighbours; of the open slots, in
    order, it takes number ``v mod (open slots)``.
    """
    free = colors.filter("color IS NULL").select("v")
    # free takes part twice in one plan, on either end of an edge
    src, dst = free.select(F.col("v").alias("src")), free.select(F.col("v").alias("dst"))
    live = edges.filter("src <> dst").join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    flags = []
    for t in range(n_hash):
        mine, other = mix32(F.col("src"), seed + SEED_STEP * t), mix32(F.col("dst"), seed + SEED_STEP * t)
        flags += [F.max(mine >= other).alias(f"x{2 * t}"), F.max(mine <= other).alias(f"x{2 * t + 1}")]
    ruled = live.groupBy(F.col("src").alias("v")).agg(*flags)
    slots = 2 * n_hash
    open_slots = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"x{i}"), F.lit(False)), F.lit(i)) for i in range(slots)]))
    chosen = (
        free.join(ruled, "v", "left")
        .withColumn("open", open_slots)
        .withColumn("n", F.size("open"))
        .select("v", F.when(F.col("n") > 0, F.get("open", (F.col("v") % F.greatest("n", F.lit(1))).cast("int")) + next_color).cast("long").alias("new"))
    )
    return colors.join(chosen, "v", "left").select("v", F.coalesce("color", "new").alias("color"))


def color_graph(edges: DataFrame, vertices: DataFrame, max_colors: int = 8, coverage: float = COVERAGE, single: bool = False) -> DataFrame:
    """Rounds until ``coverage`` of the vertices have a colour or a round adds none."""
    n_hash, next_color, seed = max_colors // 2, 0, SEED
    colors = materialize(vertices.select("v", F.lit(None).cast("long").alias("color")), "colors")
    total = colors.count()
    done = 0
    while total:
        colors = materialize(color_round(edges, colors, n_hash, next_color, seed), "colors")
        now = colors.filter("color IS NOT NULL").count()
        if single or now >= coverage * total or now == done:
            break
        done, next_color, seed = now, next_color + 2 * n_hash, mix32_py(seed, 0)
    return colors


def conflicts(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row ``(conflicts,)``: half-edges whose different ends share a colour."""
    a = colors.filter("color IS NOT NULL").select(F.col("v").alias("src"), F.col("color").alias("cs"))
    b = colors.filter("color IS NOT NULL").select(F.col("v").alias("dst"), F.col("color").alias("cd"))
    bad = edges.filter("src <> dst").join(a, "src").join(b, "dst").filter("cs = cd")
    return bad.agg(F.count(F.lit(1)).alias("conflicts"))


def color_sizes(colors: DataFrame) -> DataFrame:
    """``(color, size)``; uncoloured vertices form the last bucket, colour -1."""
    return colors.groupBy(F.coalesce("color", F.lit(-1)).cast("long").alias("color")).agg(F.count(F.lit(1)).alias("size"))


def unassigned(colors: DataFrame) -> DataFrame:
    return colors.agg(F.sum(F.col("color").isNull().cast("long")).alias("unassigned"))


