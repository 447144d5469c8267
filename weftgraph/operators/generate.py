"""Seeded graph generators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.hashing import uniform
from weftgraph.operators.build import symmetrize

# Fixed value: the circle constant that sets the radius of connectivity.
RADIUS_PI = 3.14159


def rgg_radius(n: int) -> float:
    """Mean of the connectivity radius and of the giant-component radius."""
    return (math.sqrt(math.log(n) / (RADIUS_PI * n)) + math.sqrt(2.0736 / n)) / 2.0


def points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    v = F.col("v")
    return spark.range(n).withColumnRenamed("id", "v").select("v", uniform(seed, v, F.lit("x")).alias("x"), uniform(seed, v, F.lit("y")).alias("y"))


def near_pairs(pts: DataFrame, radius: float) -> DataFrame:
    """``(src, dst, w)`` with src < dst and distance at most ``radius``.

    Points are put into square cells of that width; each point meets only the
    3 x 3 cells around it, so the join is on a key and never on all pairs.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = pts.select(F.col("v").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = pts.withColumn("o", around).select(
        F.col("v").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"),
        (cell("x") + F.col("o.i")).alias("cx"), (cell("y") + F.col("o.j")).alias("cy"),
    )
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d = F.sqrt(dx * dx + dy * dy)
    return left.join(right, ["cx", "cy"]).filter("src < dst").select("src", "dst", d.alias("w")).filter(F.col("w") <= radius)


def random_geometric(spark: SparkSession, n: int, seed: int = 0, extra_percent: float = 0.0, unit_weights: bool = False) -> DataFrame:
    """Half-edges of a random geometric graph in the unit square.

    ``extra_percent`` adds about that share of edges between random vertices
    that are not joined yet, weighted by distance.
    """
    pts = points(spark, n, seed)
    pairs = near_pairs(pts, rgg_radius(n))
    if extra_percent > 0:
        count = int(pairs.count() * extra_percent / 100)
        i = F.col("id")
        a, b = F.floor(uniform(seed + 1, i) * n).cast("long"), F.floor(uniform(seed + 2, i) * n).cast("long")
        more = spark.range(count).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).filter("src <> dst").distinct()
        more = more.join(pairs, ["src", "dst"], "left_anti")
        p = pts.select(F.col("v").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        q = pts.select(F.col("v").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        d = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
        pairs = pairs.unionByName(more.join(p, "src").join(q, "dst").select("src", "dst", d.alias("w")))
    if unit_weights:
        pairs = pairs.withColumn("w", F.lit(1.0))
    return symmetrize(pairs)


def _skips(spark: SparkSession, pairs: int, p: float, seed: int, chunk: int = 1 << 20) -> DataFrame:
    """Indices 0 <= i < pairs, each kept with probability p, by geometric jumps.

    Work follows the kept indices, not the pairs: each chunk of the index
    space is sampled on its own from (seed, chunk number).
    """
    chunks = max(1, -(-pairs // chunk))

    def draw(batches):
        for pdf in batches:
            for k in pdf["id"]:
                size = min(chunk, pairs - k * chunk)
                rng = np.random.default_rng([seed, int(k)])
                hits = rng.binomial(size, p)
                yield _frame(np.sort(rng.choice(size, hits, replace=False)) + k * chunk)

    def _frame(x):
        import pandas as pd

        return pd.DataFrame({"i": x.astype("int64")})

    return spark.range(chunks).repartition(max(1, min(chunks, 200))).mapInPandas(draw, "i long")


def _triangle(s: Column) -> Column:
    """s (s - 1) / 2 in whole numbers."""
    return F.shiftright(s, 1) * (F.shiftright(s - 1, 1) * 2 + 1)


def _pairs(idx: DataFrame, at: str) -> DataFrame:
    """Add the pair ``a`` < ``b`` that index ``at`` stands for: ``b`` is the largest with b (b - 1) / 2 <= index."""
    s, i = F.col("b"), F.col(at)
    idx = idx.withColumn("b", F.floor((1 + F.sqrt(1 + 8 * i.cast("double"))) / 2).cast("long"))
    idx = idx.withColumn("b", F.when(_triangle(s) > i, s - 1).when(_triangle(s + 1) <= i, s + 1).otherwise(s))
    return idx.withColumn("a", i - _triangle(s))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Half-edges of G(n, p), weight 1."""
    if n < 2 or p <= 0:
        return spark.createDataFrame([], "src long, dst long, w double")
    pairs = _pairs(_skips(spark, n * (n - 1) // 2, p, seed), "i")
    return symmetrize(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")))


def clustered_random(spark: SparkSession, n: int, k: int, p_in: float = 0.1, p_out: float = 0.005, seed: int = 0) -> DataFrame:
    """Half-edges of a planted partition; vertex v lies in cluster v mod k.

    Pairs inside clusters are drawn from an index over these pairs alone, so
    the work follows the edges.
    """
    small, larger = divmod(n, k)  # so many clusters have one vertex more
    of_larger, of_small = (small + 1) * small // 2, small * (small - 1) // 2
    first = larger * of_larger
    every = first + (k - larger) * of_small
    outside = erdos_renyi(spark, n, p_out, seed + 1).filter(F.col("src") % k != F.col("dst") % k)
    if not every or p_in <= 0:
        return outside
    i = F.col("i")
    cluster = F.when(i < first, F.floor(i / max(of_larger, 1))).otherwise(larger + F.floor((i - first) / max(of_small, 1))).cast("long")
    idx = _skips(spark, every, p_in, seed).withColumn("c", cluster)
    idx = idx.withColumn("at", F.when(i < first, i - F.col("c") * of_larger).otherwise(i - first - (F.col("c") - larger) * of_small))
    pairs = _pairs(idx, "at").select((F.col("c") + F.col("a") * k).alias("src"), (F.col("c") + F.col("b") * k).alias("dst"), F.lit(1.0).alias("w"))
    return symmetrize(pairs).unionByName(outside)


def barabasi_albert(spark: SparkSession, n: int, k: int, m0: int | None = None, seed: int = 0) -> DataFrame:
    """Half-edges of preferential attachment, weight 1.

    Each vertex depends on all before it, so the list of ends is built on the
    driver: 16 bytes times n times k.
    """
    m0 = max(k, m0 or k, 1)
    rng = np.random.default_rng(seed)
    src, dst, ends = [], [], []
    for v in range(1, min(m0, n)):
        src.append(v)
        dst.append(v - 1)
        ends += [v, v - 1]
    for v in range(m0, n):
        chosen: set[int] = set()
        while len(chosen) < min(k, v):
            chosen.add(int(ends[rng.integers(len(ends))]) if ends else int(rng.integers(v)))
        for u in sorted(chosen):
            src.append(v)
            dst.append(u)
            ends += [v, u]
    import pandas as pd

    frame = pd.DataFrame({"src": np.array(src, "int64"), "dst": np.array(dst, "int64"), "w": np.ones(len(src))})
    return symmetrize(spark.createDataFrame(frame, "src long, dst long, w double"))


def hyperbolic(spark: SparkSession, n: int, mean_degree: float = 6.0, gamma: float = 3.0, seed: int = 0) -> DataFrame:
    """Half-edges of a threshold random hyperbolic graph, weight 1.

    Points in a disc of radius R, denser outwards by exponent (gamma - 1)/2,
    joined within hyperbolic distance R. Points are put into radial bands;
    within a pair of bands only an angular window can be near, and the join is
    on angular cells of that width. Where the window is the whole circle, one
    band lies so far inside that it has few points; they are copied to salts
    of the other band.
    """
    alpha = (gamma - 1) / 2
    radius = 2 * math.log(max(2.0, 2 * n * alpha**2 / (math.pi * mean_degree * (alpha - 0.5) ** 2)))
    v = F.col("v")
    u, theta = uniform(seed, v, F.lit("r")), uniform(seed, v, F.lit("t"), high=2 * math.pi)
    r = F.acosh(1 + u * (math.cosh(alpha * radius) - 1)) / alpha
    pts = spark.range(n).withColumnRenamed("id", "v").select("v", r.alias("r"), theta.alias("t"))
    bands = [0.0, *[radius / 2 + i * radius / 16 for i in range(9)]]
    band = sum((F.col("r") >= b).cast("int") for b in bands[1:-1])
    pts = pts.withColumn("band", band)
    salts = max(1, n >> 16)
    out = None
    for i in range(len(bands) - 1):
        for j in range(i, len(bands) - 1):
            lo1, lo2 = bands[i], bands[j]
            if lo1 + lo2 < radius or lo1 == 0 or lo2 == 0:
                window = math.pi
            else:
                x = (math.cosh(lo1) * math.cosh(lo2) - math.cosh(radius)) / (math.sinh(lo1) * math.sinh(lo2))
                window = math.acos(max(-1.0, min(1.0, x)))
            cells = max(1, int(2 * math.pi / max(window, 1e-9)))
            cells = 1 if cells < 3 else cells
            cell = F.floor(F.col("t") * cells / (2 * math.pi)).cast("long")
            if cells == 1:
                inner, outer = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))), F.pmod(F.xxhash64("v"), F.lit(salts)).cast("long")
                a = pts.filter(F.col("band") == i).select(F.col("v").alias("a"), F.col("r").alias("r1"), F.col("t").alias("t1"), inner.alias("cell"))
                b = pts.filter(F.col("band") == j).select(F.col("v").alias("b"), F.col("r").alias("r2"), F.col("t").alias("t2"), outer.alias("cell"))
            else:
                near = F.array(F.lit(-1), F.lit(0), F.lit(1))
                a = pts.filter(F.col("band") == i).select(F.col("v").alias("a"), F.col("r").alias("r1"), F.col("t").alias("t1"), cell.alias("cell"))
                b = pts.filter(F.col("band") == j).withColumn("o", F.explode(near))
                b = b.select(F.col("v").alias("b"), F.col("r").alias("r2"), F.col("t").alias("t2"), ((cell + F.col("o") + cells) % cells).alias("cell"))
            pairs = a.join(b, "cell").filter("a < b" if i == j else "a <> b")
            out = pairs if out is None else out.unionByName(pairs)
    d = F.cosh("r1") * F.cosh("r2") - F.sinh("r1") * F.sinh("r2") * F.cos(F.col("t1") - F.col("t2"))
    pairs = out.filter(d <= math.cosh(radius))
    return symmetrize(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("w")))
