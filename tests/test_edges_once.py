"""A run builds its edges once."""

from __future__ import annotations

from weftgraph.plans import louvain as plan


def test_vertices_come_from_the_written_edges(spark, monkeypatch):
    seen = []
    of = plan.vertices_of
    monkeypatch.setattr(plan, "vertices_of", lambda edges: seen.append(edges.inputFiles()) or of(edges))
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    found = plan.louvain(edges, max_phases=1)
    assert found.assign.count() == 4 and len(seen) == 1 and seen[0]
