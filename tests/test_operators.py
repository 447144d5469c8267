"""Graph operators on golden graphs, and properties that hold on any graph."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.hashing import mix32, mix32_py
from weftgraph.functions.prefix import dense_ids, running_total
from weftgraph.operators import build, coarsen, coloring, compare, generate, modularity, partition
from weftgraph.operators import sweep as sw
from weftgraph.plans.louvain import cycled_threshold, louvain, run_phase

EDGES = "src long, dst long, w double"


def graph(spark, pairs, w=1.0):
    return build.symmetrize(spark.createDataFrame([(a, b, w) for a, b in pairs], EDGES), "once").cache()


TRIANGLES = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
RING = [(5 * b + i, 5 * b + j) for b in range(8) for i, j in itertools.combinations(range(5), 2)] + [(5 * b + 4, 5 * ((b + 1) % 8)) for b in range(8)]


def labels(df):
    return {r.v: r.comm for r in df.collect()}


def groups(df):
    out: dict = {}
    for v, c in labels(df).items():
        out.setdefault(c, set()).add(v)
    return sorted(map(sorted, out.values()))


def test_hash_golden_values(spark):
    want = [2923027454, 4125147180, 2299693805, 3557641882]
    assert [mix32_py(v, 1012) for v in range(4)] == want
    assert [r[0] for r in spark.range(4).select(mix32(F.col("id"), 1012)).collect()] == want


def test_ring_phase_traces(spark):
    edges = graph(spark, RING)
    verts = sw.degrees(edges).cache()
    compat = run_phase(edges, verts, mode="compat")
    assert [(round(q, 6), n) for q, n in compat.trace] == [(0.081095, 16), (0.420455, 8), (0.784091, 8), (0.784091, 8)]
    strict = run_phase(edges, verts)
    assert round(strict.q, 6) == 0.784091
    assert groups(strict.assign) == [list(range(5 * b, 5 * b + 5)) for b in range(8)]


def test_triangles_compat_and_true(spark):
    edges = graph(spark, TRIANGLES)
    verts = sw.degrees(edges).cache()
    compat = run_phase(edges, verts, mode="compat")
    assert round(compat.q, 6) == 0.377551 and [(round(q, 6), n) for q, n in compat.trace] == [(0.377551, 3), (0.071429, 2)]
    assert len(groups(compat.assign)) == 6
    assert round(modularity.modularity(edges, compat.assign).first()[0], 6) == -0.173469
    two = spark.createDataFrame([(v, v // 3) for v in range(6)], "v long, comm long")
    assert round(modularity.modularity(edges, two).first()[0], 6) == 0.357143


@pytest.mark.parametrize("options", [{"cycle": True, "early_stop": 1}, {"early_stop": 2, "alpha": 0.5, "ordered": True}, {"early_stop": 3}, {"early_stop": 4}, {"colored": True, "max_colors": 4}])
def test_louvain_variants(spark, options):
    edges = graph(spark, RING)
    found = louvain(edges, max_phases=2, max_iterations=4, **options)
    assert round(modularity.modularity(edges, found.assign).first()[0], 6) == round(found.q, 6)
    assert found.q > 0.2
    ids = sorted(set(labels(found.assign).values()))
    assert ids == list(range(len(ids)))
    assert found.traversed_edges > 0 and found.teps > 0


def test_threshold_cycle():
    assert [cycled_threshold(i) for i in (0, 3, 7, 10, 13)] == [1e-3, 1e-4, 1e-5, 1e-6, 1e-3]


def test_properties_of_one_sweep(spark):
    rng = random.Random(2)
    pairs = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(90)) if a < b} | {(4, 4)}
    edges = graph(spark, sorted(pairs))
    verts = sw.degrees(edges).cache()
    total = sw.total_weight(edges).first()
    after = sw.sweep(edges, sw.singletons(verts), verts, total["c"]).cache()
    info = sw.community_info(after, verts).agg(F.sum("size"), F.sum("degree")).first()
    assert (info[0], info[1]) == (verts.count(), total["two_m"])
    q = modularity.modularity(edges, after).first()[0]
    small = coarsen.relabel(after).cache()
    assert modularity.modularity(edges, small).first()[0] == pytest.approx(q)
    coarse = coarsen.coarsen(edges, small).cache()
    assert modularity.modularity(coarse, sw.singletons(sw.degrees(coarse))).first()[0] == pytest.approx(q)
    # the plain definition, vertex by vertex
    half = [tuple(r) for r in edges.collect()]
    k = {r.v: r.k for r in verts.collect()}
    got = labels(after)
    for v in k:
        loop = sum(w for a, b, w in half if a == b == v)
        best = (0.0, v)
        for u in sorted({b for a, b, _ in half if a == v and b != v}):
            into = sum(w for a, b, w in half if a == v and b == u)
            gain = 2 * (into - (loop - loop)) - 2 * k[v] * (k[u] - (k[v] - k[v])) * total["c"]
            if gain > best[0]:
                best = (gain, u)
        want = v if best[1] > v else best[1]  # all are singletons: never to a larger id
        assert got[v] == want


def test_coloring_has_no_conflicts(spark):
    edges = graph(spark, RING)
    colors = coloring.color_graph(edges, build.vertices_of(edges)).cache()
    assert coloring.conflicts(edges, colors).first()[0] == 0
    done = colors.filter("color is not null").count()
    assert done + coloring.unassigned(colors).first()[0] == 40 and done >= 28


def test_pair_counts_against_all_pairs(spark):
    rng = random.Random(5)
    t = {v: rng.randrange(4) for v in range(40)}
    f = {v: rng.randrange(5) for v in range(40)}
    a = spark.createDataFrame(list(t.items()), "v long, comm long")
    b = spark.createDataFrame(list(f.items()), "v long, comm long")
    tp = fn = fp = 0
    for u, v in itertools.combinations(range(40), 2):
        one, two = t[u] == t[v], f[u] == f[v]
        tp, fn, fp = tp + (one and two), fn + (one and not two), fp + (two and not one)
    assert tuple(compare.pair_counts(a, b).first()) == (tp, fn, fp)
    assert compare.pair_counts(b, a).first()["tp"] == tp
    assert tuple(compare.f1(a, a).first()) == (1.0, 1.0, 1.0)
    sizes = [3, 1, 4, 1, 5]
    s = sorted(sizes)
    want = 2 * sum((i + 1) * x for i, x in enumerate(s)) / (len(s) * sum(s)) - (len(s) + 1) / len(s)
    assert compare.gini(spark.createDataFrame([(x,) for x in sizes], "size long")).first()[0] == pytest.approx(want)


def test_prefix_and_numbering(spark):
    values = [(v, v % 7) for v in range(0, 1000, 3)]
    df = spark.createDataFrame(values, "v long, x long")
    got = {r.v: r.upto for r in running_total(df, F.floor(F.col("v") / 50), [F.col("v")], F.col("x"), "upto").collect()}
    total = 0
    for v, x in values:
        total += x
        assert got[v] == total
    assert [r.n for r in dense_ids(df, "v", "n").orderBy("v").collect()] == list(range(len(values)))


def test_partition_ranges(spark):
    n, parts = 37, 5
    got = {r.v: r.p for r in spark.range(n).select(F.col("id").alias("v"), partition.owner(F.col("id"), n, parts).alias("p")).collect()}
    cuts = [n * j // parts for j in range(parts + 1)]
    assert got == {v: max(j for j in range(parts) if cuts[j] <= v) for v in range(n)}
    edges = graph(spark, RING)
    row = partition.edge_stats(edges, 40, 4).first()
    assert (row.edges, row.max_edges, row.min_edges) == (176, 44, 44)
    starts = partition.greedy_bins(edges, build.vertices_of(edges), 4)
    assert starts == [0, 10, 20, 30]
    bins = partition.balance_edges(edges, build.vertices_of(edges), 4).groupBy("part").count().collect()
    assert sorted((r.part, r["count"]) for r in bins) == [(i, 10) for i in range(4)]


def test_generators(spark):
    n, seed = 300, 4
    radius = generate.rgg_radius(n)
    pts = {r.v: (r.x, r.y) for r in generate.points(spark, n, seed).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(n), 2) if ((pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2) ** 0.5 <= radius}
    got = {(r.src, r.dst) for r in generate.random_geometric(spark, n, seed).collect() if r.src < r.dst}
    assert got == want
    assert generate.random_geometric(spark, n, seed, extra_percent=10).count() > 2 * len(want)
    er = generate.erdos_renyi(spark, 200, 0.1, 1).filter("src < dst")
    assert abs(er.count() - 1990) < 200 and er.distinct().count() == er.count()
    assert er.agg(F.max("dst"), F.min("src")).first()[0] <= 199
    crg = generate.clustered_random(spark, 200, 4, 0.3, 0.01, 1).filter("src < dst").withColumn("same", F.expr("src % 4 = dst % 4"))
    counts = {r.same: r["count"] for r in crg.groupBy("same").count().collect()}
    assert counts[True] > counts[False]
    ba = generate.barabasi_albert(spark, 100, 2, seed=1)
    assert ba.filter("src < dst").distinct().count() == 1 + 98 * 2
    assert generate.hyperbolic(spark, 200, seed=1).count() > 100


# The published friendships of a karate club, 78 edges of 34 members.
KARATE = {
    0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32), 3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,),
    8: (30, 32, 33), 9: (33,), 13: (33,), 14: (32, 33), 15: (32, 33), 18: (32, 33), 19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,), 26: (29, 33),
    27: (33,), 28: (31, 33), 29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,),
}


def karate(spark):
    return graph(spark, [(a, b) for a, bs in KARATE.items() for b in bs])


def test_karate_phase_trace(spark):
    edges = karate(spark)
    verts = sw.degrees(edges).cache()
    assert (edges.count(), verts.count()) == (156, 34)
    found = run_phase(edges, verts, mode="compat")
    assert [(round(q, 6), n) for q, n in found.trace] == [(0.081114, 18), (0.088675, 11), (0.182035, 9), (0.15023, 9)]
    assert len(groups(found.assign)) == 11
    whole = louvain(edges, mode="compat", max_phases=2)
    assert round(modularity.modularity(edges, whole.assign).first()[0], 6) == 0.408695 and len(groups(whole.assign)) == 4


def plain_phase(half, sweeps, kind, alpha):
    """Lagged scores of a compat phase with early stopping, vertex by vertex."""
    vs = sorted({a for a, _, _ in half})
    k = {v: sum(w for a, _, w in half if a == v) for v in vs}
    c = 1 / sum(k.values())
    past = cur = {v: v for v in vs}
    active, p, held, scores = set(vs), dict.fromkeys(vs, 1.0), {}, []
    for n in range(1, sweeps + 1):
        deg, size = {}, {}
        for v in vs:
            deg[cur[v]] = deg.get(cur[v], 0) + k[v]
            size[cur[v]] = size.get(cur[v], 0) + 1
        target = dict(cur)
        for v in active:
            into = {}
            for a, b, w in half:
                if a == v:
                    into[cur[b]] = into.get(cur[b], 0) + w
            held[v] = into.get(cur[v], 0)
            eix = held[v] - sum(w for a, b, w in half if a == b == v)
            best = (0.0, None)
            for y in sorted(into):
                gain = 2 * (into[y] - eix) - 2 * k[v] * (deg[y] - deg[cur[v]] + k[v]) * c
                if y != cur[v] and gain > best[0] + 1e-12:
                    best = (gain, y)
            y = best[1]
            if y is not None and not (size[y] == size[cur[v]] == 1 and y > cur[v]):
                target[v] = y
        after = {}
        for v in vs:
            after[target[v]] = after.get(target[v], 0) + k[v]
        scores.append(abs(sum(held.values()) * c - sum(x * x for x in after.values()) * c * c))
        if n > 2:
            for v in list(active):
                if kind == 1 and target[v] == cur[v] == past[v]:
                    active.discard(v)
                if kind == 2 and cur[v] == past[v]:
                    p[v] *= 1 - alpha
                    if p[v] <= 0.02:
                        active.discard(v)
        if not active:
            break
        past, cur = cur, target
    return scores


@pytest.mark.parametrize(("kind", "alpha"), [(1, 1.0), (2, 0.9)])
def test_early_stop_traces(spark, kind, alpha):
    edges = karate(spark)
    verts = sw.degrees(edges).cache()
    found = run_phase(edges, verts, mode="compat", threshold=-1e9, early_stop=kind, alpha=alpha, max_iterations=5)
    want = plain_phase([tuple(r) for r in edges.collect()], 5, kind, alpha)
    assert [q for q, _ in found.trace] == pytest.approx(want)


def test_colours_with_early_stop(spark):
    edges = karate(spark)
    found = louvain(edges, colored=True, early_stop=1, max_phases=1, max_iterations=4, max_colors=4)
    assert round(modularity.modularity(edges, found.assign).first()[0], 6) == round(found.q, 6) and found.q > 0


# --- one key with most of the rows, sparse ids ------------------------------------


def test_sparse_ids_are_numbered_over_ranges(spark):
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = spark.range(5000).select(F.xxhash64("id").alias("v"))
        out = dense_ids(ids, "v", "n")
        got = [(r.v, r.n) for r in out.collect()]
        assert [n for _, n in sorted(got)] == list(range(5000))
        # the plan has no window over all rows: what meets in one task is one row a range
        from weftgraph.functions.prefix import by_ranges

        ranges = by_ranges(ids, [F.col("v")]).groupBy("__b").count().collect()
        assert len(ranges) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in ranges) < 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def test_hub_moves_without_a_window(spark):
    n = 400
    edges = graph(spark, [(0, v) for v in range(1, n)] + [(v, v + 1) for v in range(1, n - 1, 2)] + [(0, 0)])
    verts = sw.degrees(edges).cache()
    c = sw.total_weight(edges).first()["c"]
    scored = sw.gains(edges, sw.singletons(verts), verts, c)
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.v, r.comm): r.gain for r in scored.collect()}
    k = {r.v: r.k for r in verts.collect()}
    assert len(got) == 2 * (n - 1) + 2 * ((n - 1) // 2)
    for (v, y), gain in got.items():
        assert gain == pytest.approx(2.0 - 2.0 * k[v] * k[y] * c)


def test_pair_counts_are_exact_beyond_doubles(spark):
    n = 3_000_000_001
    got = spark.createDataFrame([(n,), (n - 1,)], "n long")
    want = sum(x * (x - 1) // 2 for x in (n, n - 1))
    assert compare._pairs(got, "s").first()[0] == want
    idx = [0, 1, 2, 3, 10**15, 10**15 + 1, 4 * 10**17]
    pairs = generate._pairs(spark.createDataFrame([(i,) for i in idx], "i long"), "i").collect()
    assert [r.b * (r.b - 1) // 2 + r.a for r in pairs] == idx and all(0 <= r.a < r.b for r in pairs)


def test_clustered_and_hyperbolic_against_all_pairs(spark):
    n, k, p = 300, 7, 0.5
    inner = generate.clustered_random(spark, n, k, p, 0.0, 3).filter("src < dst").collect()
    pairs = [(r.src, r.dst) for r in inner]
    every = sum(1 for a, b in itertools.combinations(range(n), 2) if a % k == b % k)
    assert len(set(pairs)) == len(pairs) and all(a % k == b % k for a, b in pairs)
    assert abs(len(pairs) - p * every) < 5 * (every * p * (1 - p)) ** 0.5
    full = generate.clustered_random(spark, 23, 4, 1.0, 0.0, 1).filter("src < dst").collect()
    assert {(r.src, r.dst) for r in full} == {(a, b) for a, b in itertools.combinations(range(23), 2) if a % 4 == b % 4}
    # hyperbolic: every pair of points by its distance
    import math

    import numpy as np

    from weftgraph.functions.hashing import uniform

    n = 250
    v = F.col("id")
    at = spark.range(n).select("id", uniform(5, v, F.lit("r")).alias("u"), uniform(5, v, F.lit("t"), high=2 * math.pi).alias("t")).orderBy("id").toPandas()
    radius = 2 * math.log(2 * n / (math.pi * 6.0 * 0.25))
    r = np.arccosh(1 + at["u"] * (math.cosh(radius) - 1)).to_numpy()
    t = at["t"].to_numpy()
    d = np.cosh(r)[:, None] * np.cosh(r) - np.sinh(r)[:, None] * np.sinh(r) * np.cos(t[:, None] - t)
    want = {(a, b) for a, b in zip(*np.where(d <= math.cosh(radius))) if a < b}
    got = [(e.src, e.dst) for e in generate.hyperbolic(spark, n, seed=5).filter("src < dst").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_extra_edges_are_new_and_weighted_by_distance(spark):
    n, seed = 200, 9
    base = {(r.src, r.dst) for r in generate.random_geometric(spark, n, seed).collect()}
    more = generate.random_geometric(spark, n, seed, extra_percent=20).collect()
    pts = {r.v: (r.x, r.y) for r in generate.points(spark, n, seed).collect()}
    extra = [(r.src, r.dst, r.w) for r in more if (r.src, r.dst) not in base]
    assert extra and len({(a, b) for a, b, _ in extra}) == len(extra) and len(more) == len(base) + len(extra)
    assert all(w == pytest.approx(((pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2) ** 0.5) for a, b, w in extra)
