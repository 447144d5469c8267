"""Phases and the multi-level driver.

The driver keeps scalars only, but for graphs of a single block. Every sweep is
one job whose result (one row a vertex) is written to the shared folder, so
lineage never grows and a lost executor costs one sweep at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import coarsen as co
from weftgraph.operators import coloring
from weftgraph.operators import sweep as sw
from weftgraph.operators.build import vertices_of
from weftgraph.plans import laid
from weftgraph.plans.blocks import Blocks, Rule, put_rows
from weftgraph.plans.stage import materialize

MAX_PHASES = 200
MAX_ITERATIONS = 10_000
INACTIVE_SHARE = 0.9
PATIENCE = 2
# The thresholds of 13 phases in turn; None is the default one.
CYCLE = (1e-3,) * 3 + (1e-4,) * 4 + (1e-5,) * 3 + (None,) * 3


def cycled_threshold(phase: int, default: float = 1e-6) -> float:
    return CYCLE[phase % len(CYCLE)] or default


@dataclass
class Phase:
    assign: DataFrame | laid.State
    q: float
    iterations: int
    trace: list[tuple[float, int]] = field(default_factory=list)  # (q, communities) in compat mode, (q, sweep) in strict mode


@dataclass
class Result:
    """``assign`` maps original vertices to communities 0 .. k-1."""

    assign: DataFrame
    q: float
    levels: list[dict]

    @property
    def traversed_edges(self) -> int:
        return sum(x["edges"] * x["iterations"] for x in self.levels)

    @property
    def seconds(self) -> float:
        return sum(x["seconds"] for x in self.levels)

    @property
    def teps(self) -> float:
        return self.traversed_edges / self.seconds if self.seconds else 0.0

    @property
    def mods(self) -> float:
        """Modularity times clustering time, a figure of merit that some tools print."""
        return self.q * self.seconds


def _one(df: DataFrame):
    return df.first()[0]


def _blocks(edges: DataFrame, vertices: DataFrame, colors: DataFrame | None) -> Blocks:
    """Colours take turns in their order; vertices without one come last."""
    if colors is None:
        return Blocks(edges, vertices)
    turn = colors.select("v", F.coalesce("color", F.lit(-1)).alias("turn"))
    ids = sorted((r[0] for r in turn.select("turn").distinct().collect()), key=lambda x: (x < 0, x))
    return Blocks(edges, vertices.join(turn, "v"), ids)


def run_sweeps(edges: DataFrame, vertices: DataFrame, sweeps: int, early_stop: int = 0, alpha: float = 1.0, colors: DataFrame | None = None) -> DataFrame:
    """The partition after so many sweeps, whatever their scores."""
    total = _one(sw.total_weight(edges).select("two_m"))
    if not total:
        return materialize(sw.singletons(vertices), "assign")
    graph = _blocks(edges, vertices, colors)
    now = graph.start()
    for k in range(1, sweeps + 1):
        now = graph.sweep(now, Rule(1.0 / total, k, early_stop, alpha))
    return graph.assign(now)


def run_phase(
    edges: DataFrame, vertices: DataFrame, threshold: float = 1e-6, mode: str = "strict", early_stop: int = 0,
    alpha: float = 1.0, colors: DataFrame | None = None, max_iterations: int = MAX_ITERATIONS,
) -> Phase:
    """Sweep until modularity stops improving.

    ``vertices`` is (v, k). ``mode="strict"`` scores each partition truly and
    returns the best one seen; ``"compat"`` reports the absolute lagged score of
    the sweep before the last and returns the partition of two sweeps before.
    ``early_stop`` 1 and 3 freeze vertices unchanged for three sweeps, 2 and 4
    decay a probability by ``alpha`` while the two partitions before the
    present one agree on a vertex; 3 and 4 also stop when 90 percent are
    frozen. In compat mode a frozen vertex counts with the edge weight of its
    last active sweep.

    The edge term of a partition is summed by the sweep that starts from it, so
    a strict phase runs one sweep ahead of the partition it scores.
    """
    if mode not in ("strict", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    total = _one(sw.total_weight(edges).select("two_m"))
    if not total:
        return Phase(materialize(sw.singletons(vertices), "assign"), 0.0, 0)
    return _phase(_blocks(edges, vertices, colors), 1.0 / total, vertices.count(), threshold, mode, early_stop, alpha, max_iterations)


def _phase(graph: Blocks | laid.Laid, c: float, n: int, threshold: float, mode: str, early_stop: int, alpha: float, max_iterations: int) -> Phase:
    previous = current = best = graph.start()
    score = lambda e_in, of: e_in * c - of.info[2] * c * c
    rule = Rule(c, 1, early_stop, alpha, hold=mode == "compat" and bool(early_stop))
    best_q, last, idle, trace, target = None, -1.0, 0, [], graph.sweep(current, rule)
    if mode == "strict":
        best_q = score(target.e_in, current)
    for k in range(1, max_iterations + 1):
        if mode == "compat":
            q = abs(score(target.e_in, target))
            trace.append((q, target.info[1]))
            if q - last < threshold:
                return Phase(graph.assign(previous), last if k > 1 else q, k, trace)
        else:
            ahead = graph.sweep(target, replace(rule, number=k + 1))
            q = score(ahead.e_in, target)
            trace.append((q, k))
            if q > best_q + threshold:
                best, best_q, idle = target, q, 0
            else:
                idle += 1
            if idle > PATIENCE:
                return Phase(graph.assign(best), best_q, k, trace)
        last = q
        if early_stop and (target.active == 0 or (early_stop in (3, 4) and n - target.active >= INACTIVE_SHARE * n)):
            return Phase(graph.assign(best if mode == "strict" else current), best_q if mode == "strict" else q, k, trace)
        previous, current = current, target
        if k < max_iterations:
            target = ahead if mode == "strict" else graph.sweep(target, replace(rule, number=k + 1))
    return Phase(graph.assign(best if mode == "strict" else previous), best_q if mode == "strict" else last, max_iterations, trace)


def louvain(
    edges: DataFrame, vertices: DataFrame | None = None, threshold: float = 1e-6, mode: str = "strict", cycle: bool = False,
    single_phase: bool = False, early_stop: int = 0, alpha: float = 1.0, colored: bool = False, ordered: bool = False,
    max_colors: int = 8, max_phases: int = MAX_PHASES, max_iterations: int = MAX_ITERATIONS, source: Callable[[], laid.Source] | None = None,
) -> Result:
    """Multi-level community detection.

    One mapping is used for both the coarse graph and the folded labels.
    ``ordered`` is accepted for completeness: a synchronous sweep does not
    depend on the order of its vertices, so it equals the plain variant.
    ``source`` gives the same half-edges, in both directions, as tasks can make
    them without rows; a strict run without colours takes them from there if
    they fit ``laid.Laid``.
    """
    if source is not None and vertices is None and mode == "strict" and not colored:
        graph = laid.lay_out(source())
        found = graph and _laid_levels(graph, dict(edges.dtypes)["src"], threshold, cycle, single_phase, early_stop, alpha, max_phases, max_iterations)
        if found:
            return found
    level_edges = materialize(edges.select("src", "dst", F.col("w").cast("double").alias("w")), "edges")
    ids = vertices_of(level_edges) if vertices is None else vertices.select("v").distinct()
    ids = materialize(ids, "vertices")
    folded, level_ids, q, levels = sw.singletons(ids), ids, None, []
    final_run = False
    for phase in range(max_phases):
        bound = 1e-6 if final_run else cycled_threshold(phase, threshold) if cycle else threshold
        began = time.time()
        level_vertices = materialize(sw.degrees(level_edges, level_ids), "degrees")
        colors = coloring.color_graph(level_edges, level_ids, max_colors) if colored and phase == 0 else None
        found = run_phase(level_edges, level_vertices, bound, mode, early_stop, alpha, colors, max_iterations)
        score = found.q
        accepted = q is None or score - q > bound
        levels.append({
            "phase": phase, "q": score, "iterations": found.iterations, "edges": level_edges.count(),
            "vertices": level_ids.count(), "seconds": time.time() - began, "threshold": bound, "accepted": accepted, "trace": found.trace,
        })
        if not accepted:
            if cycle and not final_run and bound > 1e-6:
                final_run = True  # a last level at the finest threshold, folded like any other
                continue
            break
        q = score
        numbered = materialize(co.relabel(found.assign), "relabel")
        folded = materialize(co.fold(folded, numbered), "folded")
        if single_phase or final_run:
            break
        level_edges = materialize(co.coarsen(level_edges, numbered), "edges")
        level_ids = materialize(numbered.select(F.col("comm").alias("v")).distinct(), "vertices")
    return Result(materialize(co.relabel(folded), "communities"), q or 0.0, levels)


def _laid_levels(
    graph: laid.Laid, kind: str, threshold: float, cycle: bool, single_phase: bool, early_stop: int, alpha: float, max_phases: int, max_iterations: int,
) -> Result | None:
    """The levels of ``louvain`` over laid out half-edges; nothing if a level can't be laid out."""
    spark, v, folded, q, levels, final_run = graph.spark, graph.v, np.arange(graph.n), None, [], False
    for phase in range(max_phases):
        bound = 1e-6 if final_run else cycled_threshold(phase, threshold) if cycle else threshold
        began = time.time()
        found = _phase(graph, 1.0 / graph.total, graph.n, bound, "strict", early_stop, alpha, max_iterations) if graph.total else Phase(graph.start(), 0.0, 0)
        accepted = q is None or found.q - q > bound
        levels.append({
            "phase": phase, "q": found.q, "iterations": found.iterations, "edges": graph.half_edges, "vertices": graph.n,
            "seconds": time.time() - began, "threshold": bound, "accepted": accepted, "trace": found.trace,
        })
        if not accepted:
            if cycle and not final_run and bound > 1e-6:
                final_run = True
                continue
            break
        q = found.q
        label, count = laid.renumbered(found.assign.comm)
        folded = label[folded]
        if single_phase or final_run:
            break
        graph = graph.contract(label, count)
        if graph is None:
            return None
    table = pa.table({"v": v, "comm": laid.renumbered(folded)[0]})
    return Result(put_rows(spark, table, "communities", "v long, comm long").withColumn("v", F.col("v").cast(kind)), q or 0.0, levels)
