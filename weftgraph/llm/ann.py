"""Nearest neighbours over learned partitions.

A sample's neighbour graph is cut into balanced partitions; a small
classifier learns which partitions hold a vector's neighbours and routes every
row to one partition and every query to its most probable ones, whose rows are
then ranked exactly. The number of partitions follows the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import sampled
from weftgraph.plans.stage import materialize


@dataclass(frozen=True)
class AnnParams:
    """A partition is meant to hold about ``part_rows`` rows, so their number grows with the table, up to ``max_partitions``.

    Fitted on about ``sample`` rows, or ``part_sample`` a partition if that is
    more (so at most 65,536 on the driver), ``neighbours`` of each in the
    graph. A query probes its most probable partitions until they hold the
    probability that gives ``recall`` on ``trial`` held-out sample rows.
    Neighbouring partitions are searched together, as a region of at most
    about ``region_bytes`` of vectors that one task holds and that meets about
    ``query_rows`` queries; ``block_rows`` are scored at a time.
    """

    k: int = 20
    part_rows: int = 512
    max_partitions: int = 4096
    sample: int = 8192
    part_sample: int = 16
    neighbours: int = 20
    hidden: int = 96
    epochs: int = 12
    recall: float = 0.95
    trial: int = 512
    block_rows: int = 4096
    query_rows: int = 65_536
    region_bytes: int = 64 << 20
    seed: int = 5

    def partitions(self, rows: int) -> int:
        """A power of two."""
        parts = 1
        while parts < self.max_partitions and parts * self.part_rows < rows:
            parts *= 2
        return parts

    def regions(self, rows: int, dim: int, parts: int, cores: int) -> int:
        """A power of two: no more than keep ``cores`` busy and each task's share in memory."""
        regions = 1
        while regions < parts and (regions < cores or regions * self.region_bytes < 8 * dim * rows):
            regions *= 2
        return regions


@dataclass
class Router:
    """A perceptron with one hidden layer over ``parts`` partitions; those of probability ``mass`` are searched."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0
    sample_recall: float = 1.0
    probes: float = 1.0

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions by falling probability, and the probability before each."""
        z = self.scores(x)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p


def usable(vec: Column, dim: int) -> Column:
    """Not null, of ``dim`` components, all finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) == dim) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """(n, k) of the largest inner products, self excluded."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int32)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, sweeps: int = 12, slack: float = 1.05) -> np.ndarray:
    """A partition of the graph into ``parts`` of at most ``slack`` times the mean size, few edges cut.

    Halved by principal directions to begin with, so that partitions with the
    same low bits lie together; then vertices move to the partition of most of
    their neighbours where that gains edges and has room.
    """
    labels = np.zeros(len(x), dtype=np.int32)
    for level in range(int(np.log2(parts))):
        for p in range(1 << level):
            at = np.flatnonzero(labels == p)
            if len(at) > 1:
                c = x[at] - x[at].mean(0)
                _, _, v = np.linalg.svd(c.T @ c)
                labels[at[np.argsort(c @ v[0])[len(at) // 2 :]]] += 1 << level
    cap, rng = int(np.ceil(len(x) / parts * slack)), np.random.default_rng(seed)
    size = np.bincount(labels, minlength=parts)
    # neighbours in both directions, one list a vertex
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x), dtype=np.int32), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    ends = ends[np.argsort(starts, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(starts, minlength=len(x)))]
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(len(x)):
            near, count = np.unique(labels[ends[at[v] : at[v + 1]]], return_counts=True)
            to, own = near[count.argmax()], labels[v]
            if to != own and count.max() > count[near == own].sum() and size[to] < cap:
                labels[v] = to
                size[to] += 1
                size[own] -= 1
                moved += 1
        if moved < len(x) // 200:
            break
    return labels


def train_router(x: np.ndarray, near: np.ndarray, parts: int, params: AnnParams) -> Router:
    """Adam on cross entropy against the shares of each vector's neighbours by partition; ``near`` (n, k) are their partitions."""
    rng = np.random.default_rng(params.seed)
    d = x.shape[1]
    theta = [rng.normal(0, (2 / d) ** 0.5, (d, params.hidden)), np.zeros(params.hidden), rng.normal(0, params.hidden**-0.5, (params.hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for _ in range(params.epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            target = np.zeros((len(at), parts))
            np.add.at(target, (np.repeat(np.arange(len(at)), near.shape[1]), near[at].ravel()), 1 / near.shape[1])
            h = np.maximum(x[at] @ theta[0] + theta[1], 0)
            z = h @ theta[2] + theta[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target) / len(at)
            back = (g @ theta[2].T) * (h > 0)
            grads = [x[at].T @ back, back.sum(0), h.T @ g, g.sum(0)]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                theta[i] = theta[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*theta)


def fit(sample: np.ndarray, params: AnnParams, parts: int) -> Router:
    """Graph, partition, classifier, and the probability mass that the recall needs.

    The last ``trial`` rows of the sample only test; the router has not seen
    them. Fewer than 16 rows a partition: fewer partitions; one is searched
    whole.
    """
    while parts > 1 and len(sample) < 16 * parts:
        parts //= 2
    if parts <= 1:
        d = sample.shape[1] if sample.ndim == 2 else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = min(params.trial, len(sample) // 8)
    x, test = sample[:-held], sample[-held:]
    graph = neighbour_graph(x, params.neighbours)
    labels = balanced_partition(x, graph, parts, params.seed)
    router = train_router(x, labels[graph], parts, params)
    placed = np.concatenate([router.scores(x).argmax(1) for x in np.array_split(sample, -(-len(sample) // 4096))])
    s = test @ sample.T
    s[np.arange(held), len(x) + np.arange(held)] = -np.inf
    k = min(params.k, len(sample) - 1)
    true = placed[np.argpartition(-s, k - 1, axis=1)[:, :k]]
    order, before = router.ranked(test)
    rank = np.argsort(order, axis=1)
    # a partition is probed if less than the mass lies before it
    need = np.take_along_axis(before, np.take_along_axis(rank, true, axis=1), axis=1)
    router.mass = float(np.quantile(need, params.recall, method="higher")) + 1e-9
    router.sample_recall = float((need < router.mass).mean())
    router.probes = float((before < router.mass).sum(1).mean())
    return router


def dimension(rows: DataFrame, vec: str) -> int:
    """The commonest number of components; ties to the smaller."""
    top = rows.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0").orderBy(F.desc("n"), "d").first()
    return int(top["d"]) if top else 0


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in series]) if len(series) else np.zeros((0, 1))


FOUND = "query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Block:
    """Rows of a region, ordered by partition; ``pieces`` are (partition's place in ``parts``, from, to)."""

    ids: np.ndarray
    vecs: np.ndarray
    parts: np.ndarray
    pieces: list[tuple[int, int, int]]
    longest: float

    @classmethod
    def of(cls, ids: np.ndarray, vecs: np.ndarray, part: np.ndarray, most: int) -> Block:
        parts, at = np.unique(part, return_index=True)
        ends = [*at[1:], len(part)]
        pieces = [(i, x, min(x + most, end)) for i, (start, end) in enumerate(zip(at, ends)) for x in range(start, end, most)]
        return cls(ids, vecs, parts, pieces, float(np.sqrt((vecs**2).sum(axis=1)).max()))


def nearest(q_id: np.ndarray, q: np.ndarray, probes: list[np.ndarray], block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k of the block's partitions that it probes, but itself: (query, vec, score), ties to the smaller id.

    Matrix products select, with all near ties; the scores returned are sums
    from the first component to the last, so equal vectors score equally
    anywhere.
    """
    who, flat = np.repeat(np.arange(len(q)), [len(p) for p in probes]), np.concatenate(probes)
    at = np.searchsorted(block.parts, flat).clip(max=len(block.parts) - 1)
    held = block.parts[at] == flat
    asked = np.zeros((len(q), len(block.parts)), dtype=bool)
    asked[who[held], at[held]] = True
    slack = 1e-11 * block.longest * np.sqrt((q**2).sum(axis=1))  # sums in another order differ by less
    bound = np.full(len(q), -np.inf)  # k rows of one piece are as near
    rows, cols, near = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for p, a, b in block.pieces:
        who = np.flatnonzero(asked[:, p])
        if len(who):
            s = q[who] @ block.vecs[a:b].T
            s[q_id[who][:, None] == block.ids[a:b]] = -np.inf
            if b - a >= k:
                bound[who] = np.maximum(bound[who], np.partition(s, b - a - k, axis=1)[:, b - a - k])
            i, j = np.nonzero((s >= (bound - slack)[who][:, None]) & (s > -np.inf))
            rows.append(who[i])
            cols.append(a + j)
            near.append(s[i, j])
    row, col, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(near)
    order = np.lexsort((-s, row))
    row, col, s = row[order], col[order], s[order]
    first = np.searchsorted(row, np.arange(len(q) + 1))
    full = np.flatnonzero(np.diff(first) >= k)
    bound[full] = s[first[full] + k - 1]
    keep = s >= (bound - slack)[row]
    row, col = row[keep], col[keep]
    exact = (block.vecs[col] * q[row]).cumsum(axis=1)[:, -1]
    order = np.lexsort((block.ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return q_id[row[best]], block.ids[col[best]], exact[best]


def blocks_of(batches: Iterator[pd.DataFrame], k: int, block_rows: int = 4096, step: int = 256) -> Iterator[pd.DataFrame]:
    """Ranks queries against blocks (``FOUND``): rows sorted by (region, salt, chunk, asks, part), so a block comes before its queries.

    Holds one block and one batch of queries, however many queries there are.
    A query gets at most ``k`` rows of a block, however many of its partitions
    it probes.
    """
    key, held, block = None, [], None
    for pdf in batches:
        if not len(pdf):
            continue
        of = pdf[["region", "salt", "chunk"]].to_numpy()
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:]):
            rows = pdf.iloc[a:b]
            if key != tuple(of[a]):
                key, held, block = tuple(of[a]), [], None
            asks = rows["asks"].to_numpy(dtype=bool)
            if not asks.all():
                mine = rows[~asks]
                held.append((mine["vec_id"].to_numpy(), matrix(mine["vec"]), mine["part"].to_numpy(dtype=np.int64)))
            if asks.any() and (held or block):
                if held:
                    block, held = Block.of(*(np.concatenate(x) for x in zip(*held)), block_rows), []
                mine = rows[asks]
                for at in range(0, len(mine), step):
                    few = mine.iloc[at : at + step]
                    probes = [np.asarray(p, dtype=np.int64) for p in few["probes"]]
                    q, c, score = nearest(few["vec_id"].to_numpy(), matrix(few["vec"]), probes, block, k)
                    yield pd.DataFrame({"query_id": q, "vec_id": c, "score": score})


def usable_rows(rows: DataFrame, is_query: Column, id: str, vec: str) -> tuple[DataFrame, int]:
    """``(vec_id, vec, asks)`` of the rows that take part, repeated rows once, and their dimension."""
    dim = dimension(rows, vec)
    picked = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = picked.filter(usable(F.col("vec"), dim) & F.col("vec_id").isNotNull()) if dim else picked.limit(0)
    return good.dropDuplicates(["vec_id", "vec", "asks"]), dim


def search(rows: DataFrame, is_query: Column, params: AnnParams = AnnParams(), id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``RESULT``: the nearest rows of each query row, by inner product in double precision.

    Vectors that are null, zero, of another length than most, or with null or
    non-finite components neither ask nor answer, nor do null ids. Every other
    row is indexed. Rows with equal ids do not find each other, equal rows
    count once; an id that asks with several vectors gets the best of all.
    Ties go to the smaller id. An empty table gives an empty one; other
    columns, whatever their names, take no part.

    Queries go to the regions that hold partitions they probe, one copy a
    region, and get their best ``k`` there from those partitions alone; the
    index is copied only where a region is asked by more than ``query_rows``,
    and a region too large for a task is dealt over several. Of equal vectors only the ``k`` + 1 smallest ids can
    be found by a query, so no more are indexed: a third of all rows being
    equal makes no large block.
    """
    spark = rows.sparkSession
    good, dim = usable_rows(rows, is_query, id, vec)
    good = materialize(good.withColumn("key", F.xxhash64("vec")), "vectors")
    total = good.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    parts = params.partitions(total)
    bound = max(params.sample, params.part_sample * parts)
    drawn = sampled(good.select("vec_id", "vec"), F.xxhash64(F.lit(params.seed), "vec_id", "vec"), bound, total).toPandas()
    drawn = drawn.sort_values("vec_id", kind="stable")  # so that reruns fit alike
    sample = matrix(drawn["vec"])
    router = fit(sample[np.random.default_rng(params.seed).permutation(len(sample))], params, parts)
    held = spark.sparkContext.broadcast(router)  # 8 bytes times hidden units times partitions

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = held.value
        for pdf in batches:
            if len(pdf):
                order, before = router.ranked(matrix(pdf["vec"]))
                probes = [o[b < router.mass].astype("int32") if a else np.zeros(0, "int32") for o, b, a in zip(order, before, pdf["asks"])]
                yield pdf.assign(part=order[:, 0].astype("int32"), probes=probes)

    placed = materialize(good.mapInPandas(place, "vec_id long, vec array<double>, asks boolean, key long, part int, probes array<int>"), "placed")
    same = Window.partitionBy("key", "vec").orderBy("vec_id")
    index = placed.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= params.k + 1).select("part", "vec_id", "vec")
    index = materialize(index, "index")
    regions = params.regions(total, dim, router.parts, spark.sparkContext.defaultParallelism)
    index = index.withColumn("region", F.col("part") % regions)
    asks = placed.filter("asks").select("vec_id", "vec", "probes", F.explode(F.array_distinct(F.transform("probes", lambda p: p % regions))).alias("region"))
    asks = asks.withColumn("probes", F.filter("probes", lambda p: p % regions == F.col("region")))
    # one row a region that holds rows
    sizes = index.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    asked = asks.groupBy("region").agg(F.count(F.lit(1)).alias("queries"))
    at_least = lambda n, each: F.greatest(F.ceil(n / each), F.lit(1)).cast("int")
    # twice the bytes: a region near the bound is not dealt over two for a few rows
    plan = sizes.join(asked, "region").select("region", at_least(F.col("rows"), max(1, 2 * params.region_bytes // (8 * dim))).alias("salts"), at_least(F.col("queries"), params.query_rows).alias("chunks"))
    plan = materialize(plan, "blocks")
    hashed = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vec"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = lambda t: F.lit(None).cast(t)
    left = index.join(plan, "region").select("region", hashed(1, F.col("salts")).alias("salt"), each(F.col("chunks")).alias("chunk"), F.lit(False).alias("asks"), "part", none("array<int>").alias("probes"), "vec_id", "vec")
    right = asks.join(plan, "region").select("region", each(F.col("salts")).alias("salt"), hashed(2, F.col("chunks")).alias("chunk"), F.lit(True).alias("asks"), none("int").alias("part"), "probes", "vec_id", "vec")
    by = ["region", "salt", "chunk"]
    dealt = left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "asks", "part")
    found = dealt.mapInPandas(lambda batches: blocks_of(batches, params.k, params.block_rows), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
