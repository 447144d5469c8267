"""Sweeps over blocks: the moves of the relational sweep, without its jobs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import build, coloring, modularity
from weftgraph.operators import sweep as sw
from weftgraph.plans import blocks
from weftgraph.plans.louvain import _blocks, louvain, run_phase, run_sweeps

EDGES = "src long, dst long, w double"


def labels(df):
    return {r.v: r.comm for r in df.collect()}


def tangle(spark):
    """Sparse ids, a vertex linked to all others, loops, parallel edges, and one vertex without edges."""
    draw = random.Random(5)
    pairs = [(7 * draw.randrange(120), 7 * draw.randrange(120), float(draw.randrange(1, 4))) for _ in range(500)]
    pairs += [(10**12, 7 * i, 1.0) for i in range(120)]
    edges = build.symmetrize(spark.createDataFrame(pairs, EDGES), "once").cache()
    ids = build.vertices_of(edges).unionByName(spark.createDataFrame([(-5,)], "v long"))
    return edges, sw.degrees(edges, ids).cache()


@pytest.mark.parametrize("block, hub", [(1 << 19, 1 << 21), (100, 1 << 21), (100, 100)])
def test_moves_are_those_of_the_relational_sweep(spark, monkeypatch, block, hub):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "HUB", hub)
    edges, verts = tangle(spark)
    c = sw.total_weight(edges).first()["c"]
    graph = blocks.Blocks(edges, verts)
    assert graph.held == (block > 100) and (graph.hubs is None) == (hub > 100)
    now, want = graph.start(), sw.singletons(verts).localCheckpoint()
    for k in range(1, 4):
        after = graph.sweep(now, blocks.Rule(c, k))
        assert after.e_in == modularity.internal_weight(edges, want).first()[0]
        now, want = after, sw.sweep(edges, want, verts, c).localCheckpoint()
        assert labels(graph.assign(now)) == labels(want)
        assert now.info[1] == want.select("comm").distinct().count()
        assert now.info[2] == sw.community_info(want, verts).agg(F.sum(F.col("degree") * F.col("degree"))).first()[0]


@pytest.mark.parametrize("block", [1 << 19, 60])
def test_turns_are_those_of_the_relational_sweep(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    edges, verts = tangle(spark)
    c = sw.total_weight(edges).first()["c"]
    colors = coloring.color_graph(edges, verts, 2).cache()
    graph = _blocks(edges, verts, colors)
    assert graph.held == (block > 60)
    now, want = graph.start(), sw.singletons(verts).localCheckpoint()
    of = F.coalesce("color", F.lit(-1))
    for k in (1, 2):
        now, target = graph.sweep(now, blocks.Rule(c, k)), want
        for color in sorted({r[0] for r in colors.select(of).collect()}, key=lambda x: (x < 0, x)):
            own = edges.join(colors.filter(of == color).select(F.col("v").alias("src")), "src", "left_semi")
            moves = sw.best_moves(sw.gains(own, want, verts, c, sw.community_info(target, verts)))
            target = sw.apply_moves(target, moves).localCheckpoint()
        want = target
        assert labels(graph.assign(now)) == labels(want)


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_sweeps_of_a_small_graph_start_no_more_jobs(spark):
    edges, verts = tangle(spark)
    colors = coloring.color_graph(edges, verts, 4).cache()
    for i, c in enumerate((None, colors)):
        one, few = _jobs(spark, f"one{i}", lambda c=c: run_phase(edges, verts, -1e9, max_iterations=1, colors=c))
        six, same = _jobs(spark, f"six{i}", lambda c=c: run_phase(edges, verts, -1e9, max_iterations=6, colors=c))
        assert (one.iterations, six.iterations) == (1, 6) and 0 < same <= few + 2


@pytest.mark.parametrize("options", [{}, {"early_stop": 3, "cycle": True}])
def test_blocks_do_not_change_a_whole_run(spark, monkeypatch, options):
    edges, verts = tangle(spark)
    held = louvain(edges, verts, **options)
    monkeypatch.setattr(blocks, "BLOCK", 200)
    spread = louvain(edges, verts, **options)
    assert labels(held.assign) == labels(spread.assign) and [x["trace"] for x in held.levels] == [x["trace"] for x in spread.levels]


@pytest.mark.parametrize("near", [1 << 18, 0])
def test_a_sweep_of_few_vertices_is_one_job_a_turn(spark, monkeypatch, near):
    monkeypatch.setattr(blocks, "BLOCK", 100)
    monkeypatch.setattr(blocks, "NEAR", near)
    edges, verts = tangle(spark)
    c = sw.total_weight(edges).first()["c"]
    colors = coloring.color_graph(edges, verts, 2).cache()
    for i, by in enumerate((None, colors)):
        graph = _blocks(edges, verts, by)
        assert not graph.held and graph.near == (near > 0)
        (now, _), jobs = _jobs(spark, f"near{near}{i}", lambda: ((after := graph.sweep(graph.start(), blocks.Rule(c))), after.info))
        assert (jobs == len(graph.parts)) == graph.near
        want = run_sweeps(edges, verts, 2, 3, colors=by)
        monkeypatch.setattr(blocks, "BLOCK", 1 << 19)
        same = run_sweeps(edges, verts, 2, 3, colors=by)
        monkeypatch.setattr(blocks, "BLOCK", 100)
        assert labels(want) == labels(same)


@pytest.mark.parametrize("near", [1 << 18, 0])
def test_small_blocks_share_a_task(spark, monkeypatch, near):
    put = blocks._by_turn
    monkeypatch.setattr(blocks, "_by_turn", lambda rows, key, path, turns, *count: put(rows, key, path, turns, 37))
    monkeypatch.setattr(blocks, "BLOCK", 400)
    monkeypatch.setattr(blocks, "NEAR", near)
    edges, verts = tangle(spark)
    c = sw.total_weight(edges).first()["c"]
    graph = blocks.Blocks(edges, verts)
    (_, tasks, spans), = graph.parts
    assert sum(map(len, tasks)) > 20 and len(tasks) == len(spans) <= 2 * -(-edges.count() // 400)
    now, want = graph.start(), sw.singletons(verts).localCheckpoint()
    for k in (1, 2):
        now, want = graph.sweep(now, blocks.Rule(c, k)), sw.sweep(edges, want, verts, c).localCheckpoint()
        assert labels(graph.assign(now)) == labels(want)
