"""Runs over laid out half-edges: the levels of the relational run."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.plans import catalogue, derive, laid
from weftgraph.plans import louvain as plan


def _told(found):
    return {r.v: r.comm for r in found.assign.collect()}, [(x["trace"], x["edges"], x["vertices"], x["accepted"]) for x in found.levels]


def _orders(spark, path):
    """Repeated lines, nulls, sparse and negative parts, an order with a tenth of the lines, a part in most orders."""
    draw = random.Random(3)
    rows = [(draw.randrange(400), draw.choice((1, -7, 10**12)) * draw.randrange(60)) for _ in range(2000)] + [(7, 3 * i) for i in range(200)]
    rows += [(i, 5) for i in range(300)] + [(None, 4), (9, None)] + [(10**9 + i, 10**6 + i) for i in range(20)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("small, options", [(False, {}), (True, {}), (True, {"early_stop": 3, "cycle": True}), (True, {"early_stop": 2, "alpha": 0.5}), (False, {"single_phase": True})])
def test_levels_are_those_of_the_run_over_rows(spark, tmp_path, monkeypatch, small, options):
    if small:
        for name, value in (("BLOCK", 500), ("DEALT", 300), ("SAMPLE", 400)):
            monkeypatch.setattr(laid, name, value)
        monkeypatch.setattr(derive, "LINES", 90)
    d = _orders(spark, tmp_path)
    monkeypatch.setattr(laid, "MOST", 0 if not small and not options else 1 << 21)  # once left to the run over rows
    sizes = []
    start = laid.Laid.__init__
    monkeypatch.setattr(laid.Laid, "__init__", lambda self, *args: start(self, *args) or sizes.append(len(self.paths)))
    got = plan.louvain(derive.copurchase(spark, d), source=lambda: derive.copurchase_source(spark, d), **options)
    assert _told(got) == _told(plan.louvain(derive.copurchase(spark, d), **options))
    assert bool(sizes) == (small or bool(options)) and (not small or sizes[0] > 5)


def test_a_block_that_is_too_large_is_left_to_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(laid, "LARGEST", 100)
    d = _orders(spark, tmp_path)
    assert laid.lay_out(derive.copurchase_source(spark, d)) is None


def test_no_orders(spark, tmp_path):
    spark.createDataFrame([], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plan.louvain(derive.copurchase(spark, str(tmp_path)), source=lambda: derive.copurchase_source(spark, str(tmp_path)))
    assert found.assign.count() == 0


@pytest.mark.parametrize("name", ["louvain_full", "louvain_early_stop"])
def test_half_edges_of_registered_runs_never_become_rows(spark, monkeypatch, name):
    """edges, vertices, degrees and blocks as rows took most of the time."""
    monkeypatch.setattr(plan, "_blocks", lambda *args: pytest.fail("rows"))
    monkeypatch.setattr(plan, "materialize", lambda *args: pytest.fail("rows"))
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    parts = derive.copurchase(spark, "/root/testdata/sf0.001").select("src").distinct()
    assert found.count() == parts.count() and found.join(parts, F.col("v") == F.col("src"), "left_anti").isEmpty()


def test_merged_sums_in_order_whatever_the_span():
    draw = np.random.default_rng(1)
    for far in (1, 1 << 40):
        src, dst, w = draw.integers(-9, 9, 500) * far, draw.integers(-9, 9, 500) * far, draw.integers(1, 5, 500).astype(float)
        for weights in (None, w, w.astype(np.uint8), np.ones(500, np.uint8)):
            want: dict = {}
            for i in range(500):
                want[(src[i], dst[i])] = want.get((src[i], dst[i]), 0.0) + (1.0 if weights is None else float(weights[i]))
            s, d, x = laid.merged(src, dst, weights)
            assert list(zip(s, d)) == sorted(want) and list(x) == [want[y] for y in sorted(want)]


def test_pairs_are_cut_between_orders_only():
    batch = lambda k, v: pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "v": pa.array(v, pa.int64())})
    keys = np.repeat(np.arange(50), 4)
    values = np.tile([1, 2, 3, 3], 50)
    parts = list(derive._paired((batch(keys[i : i + 7], values[i : i + 7]) for i in range(0, 200, 7)), 10))
    src, dst, w = laid.merged(*[np.concatenate([x[i] for x in parts]) for i in (0, 1)], None)
    assert list(zip(src, dst, w)) == [(a, b, 50.0) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]
