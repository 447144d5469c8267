"""A whole run in numpy: half-edges are dealt to blocks once a level and never become rows.

A task makes half-edges from the rows it reads, sums parallel ones and sends
each block its share as one value, so the exchange has a row a task and block.
A block is a file in the shared folder: its vertices in order, and their
half-edges by numbers of ends. A sweep is one job, a task a block; the driver
holds a few values a vertex, so graphs of over ``MOST`` vertices, and such with
a block of over ``LARGEST`` half-edges, are left to ``blocks.Blocks``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.blocks import Rule, _fs, _numbered, best, settle
from weftgraph.plans.stage import new_path

BLOCK = 1 << 20  # half-edges a block, about
LARGEST = 1 << 22  # half-edges a task merges
MOST = 1 << 21  # vertices whose labels the driver holds
DEALT = 1 << 21  # half-edges a task merges before it deals them
PIECE = 1 << 17  # half-edges scored at once
SAMPLE = 1 << 18  # rows that tell where blocks end
Halves = tuple[np.ndarray, np.ndarray, np.ndarray | None]


@dataclass(frozen=True)
class Source:
    """Half-edges, in both directions, that ``make`` makes of ``rows``.

    Rows of one ``key`` belong together; ``make`` gets them in one task and by
    ascending key. It yields ``src, dst, w``; no ``w`` means 1.0 each.
    """

    rows: DataFrame
    key: str
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[Halves]]


# --- in a task ----------------------------------------------------------------


def _put(path: str, what) -> None:
    fs, inner = _fs(path)
    fs.create_dir(inner.rsplit("/", 1)[0])
    with fs.open_output_stream(inner) as f:
        pickle.dump(what, f, protocol=5)


def _drop(path: str) -> None:
    """A file, or a folder, that no one reads any more."""
    fs, inner = _fs(path)
    (fs.delete_file if fs.get_file_info(inner).is_file else fs.delete_dir)(inner)


def _get(path: str):
    fs, inner = _fs(path)
    with fs.open_input_file(inner) as f:
        return pickle.loads(f.readall())


_READ: dict[str, object] = {}  # what this worker has read last


def _kept(path: str):
    if path not in _READ:
        found = _get(path)
        for old in list(_READ)[:-1]:  # the vertices of a level and the labels of a sweep
            del _READ[old]
        _READ[path] = found
    _READ[path] = _READ.pop(path)  # the last one used goes last
    return _READ[path]


def merged(src: np.ndarray, dst: np.ndarray, w: np.ndarray | None) -> Halves:
    """In order, parallel half-edges summed."""
    if not len(src):
        return src, dst, np.zeros(0)
    if w is not None and w.dtype == np.uint8:
        if w.min() and w.sum(dtype=np.int64) <= 1.25 * len(w):  # nearly all are 1
            src, dst, w = np.repeat(src, w), np.repeat(dst, w), None
        else:
            w = w.astype(float)
    s0, d0 = int(src.min()), int(dst.min())
    bits = (int(dst.max()) - d0).bit_length()
    if (int(src.max()) - s0).bit_length() + bits <= 62:
        key = ((src - s0) << bits) | (dst - d0)
        if w is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, w = key[order], w[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        src, dst = (key[starts] >> bits) + s0, (key[starts] & ((1 << bits) - 1)) + d0
    else:
        order = np.lexsort((dst, src))
        src, dst, w = src[order], dst[order], w if w is None else w[order]
        starts = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
        src, dst, key = src[starts], dst[starts], order
    return src, dst, np.diff(np.r_[starts, len(key)]).astype(float) if w is None else np.add.reduceat(w, starts)


def _small(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Integers as a base and what is above it, in few bytes."""
    base = int(x.min()) if len(x) else 0
    return base, (x - base).astype(np.uint32) if len(x) and int(x.max()) - base < 1 << 32 else x - base


def _weights(w: np.ndarray) -> np.ndarray:
    byte = w.astype(np.uint8) if len(w) and 0 <= w.min() and w.max() < 256 else None
    return byte if byte is not None and (byte == w).all() else w


def _dealt(halves: Iterator[Halves], bounds: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """For each block its share of the half-edges, as one value."""

    def deal(parts: list[Halves]) -> Iterator[pa.RecordBatch]:
        ones = all(x[2] is None for x in parts)
        src, dst, w = merged(*[np.concatenate([x[i] for x in parts]) for i in (0, 1)], None if ones else np.concatenate([np.ones(len(x[0])) if x[2] is None else x[2] for x in parts]))
        cuts = np.r_[0, np.searchsorted(src, bounds), len(src)]
        for low in range(0, len(bounds) + 1, 64):  # no batch holds all of it
            at = [i for i in range(low, min(low + 64, len(bounds) + 1)) if cuts[i] < cuts[i + 1]]
            data = [pickle.dumps((_small(src[(c := slice(cuts[i], cuts[i + 1]))]), _small(dst[c]), _weights(w[c])), protocol=5) for i in at]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    held, rows = [], 0
    for part in halves:
        held.append(part)
        rows += len(part[0])
        if rows >= most:
            yield from deal(held)
            held, rows = [], 0
    if rows:
        yield from deal(held)


LAID = "block int, path string, n long, v binary, k binary"


def _lay(batches: Iterator[pa.RecordBatch], root: str, largest: int) -> Iterator[pa.RecordBatch]:
    """Writes the blocks that these shares make up; a row has no path if its block is too large."""
    parts: dict[int, list[Halves]] = {}
    rows: dict[int, int] = {}
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            (s0, src), (d0, dst), w = pickle.loads(data.as_buffer())
            rows[b] = rows.get(b, 0) + len(src)
            if rows[b] <= largest:
                parts.setdefault(b, []).append((src.astype(np.int64) + s0, dst.astype(np.int64) + d0, w))
    for b, many in rows.items():
        path, n, v, k, own = None, many, np.zeros(0, np.int64), np.zeros(0), parts.pop(b, [])
        if many <= largest:
            src, dst, w = merged(*[np.concatenate([x[i] for x in own]) for i in (0, 1)], np.concatenate([x[2] for x in own]))
            starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
            v, k, n = src[starts], np.add.reduceat(w, starts), len(src)
            ends, at = _numbered(np.concatenate([dst, v]))
            path = new_name(root)
            _put(path, {"v": v, "k": k, "many": np.diff(np.r_[starts, n]).astype(np.int32), "ends": ends, "dst": at[:n].astype(np.int32), "own": at[n:].astype(np.int32), "w": _weights(w)})
        row = {"block": pa.array([b], pa.int32()), "path": pa.array([path], pa.string()), "n": pa.array([n], pa.int64()), "v": pa.array([v.tobytes()], pa.binary()), "k": pa.array([k.tobytes()], pa.binary())}
        yield pa.RecordBatch.from_pydict(row)


def new_name(root: str) -> str:
    """A name of its own for each attempt of a task."""
    return f"{root}/{uuid.uuid4().hex}"


def _swept(path: str, vertices: str, labels: str, rule: Rule) -> tuple[np.ndarray, float, np.ndarray | None, np.ndarray | None]:
    """Of a block's vertices: the communities they take, the weight inside the present ones, ``p`` and ``active``."""
    x, all_v, now = _get(path), _kept(vertices), _kept(labels)
    at = np.searchsorted(all_v, x["ends"])
    comms, local = _numbered(now["place"][at])
    ids, size, degree = now["comms"][comms], now["size"][comms], now["degree"][comms]
    own, k = x["own"], x["k"]
    oi, mine = local[own], at[own]
    active = np.ones(len(oi), bool) if now["active"] is None else now["active"][mine]
    target, e, upto = np.empty(len(oi), np.int64), 0.0, np.r_[0, np.cumsum(x["many"], dtype=np.int64)]
    low = 0
    while low < len(oi):  # few at once: their arrays stay in the processor's cache
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + PIECE, side="right")) - 1)
        v, h = slice(low, high), slice(upto[low], upto[high])
        si, di, w = np.repeat(np.arange(high - low), x["many"][v]), x["dst"][h], x["w"][h].astype(float)
        loops = own[v][si] == di
        loop = np.bincount(si[loops], weights=w[loops], minlength=high - low)
        target[v], inside = best(si, local[di], oi[v], w, loop, k[v], active[v], ids, size, degree, rule.c)
        e, low = e + float(inside.sum()), high
    if not rule.early_stop:
        return target, e, None, None
    p = np.ones(len(oi)) if now["p"] is None else now["p"][mine]
    p, active = settle(rule, target, ids[oi], now["prev"][mine], p, active, lambda y: y.astype(float))
    return target, e, p if rule.early_stop in (2, 4) else None, active


def _contracted(paths: list[str], vertices: str, labels: str) -> Iterator[Halves]:
    for path in paths:
        x, all_v, label = _get(path), _kept(vertices), _kept(labels)
        of = label[np.searchsorted(all_v, x["ends"])]
        yield merged(np.repeat(of[x["own"]], x["many"]), of[x["dst"]], x["w"].astype(float))


# --- on the driver ------------------------------------------------------------


@dataclass
class State:
    """The partition after a sweep. ``e_in`` is the weight inside the communities of the sweep before."""

    graph: Laid
    comm: np.ndarray
    prev: np.ndarray
    p: np.ndarray | None = None
    flags: np.ndarray | None = None
    e_in: float = 0.0

    @property
    def active(self) -> int:
        return len(self.comm) if self.flags is None else int(self.flags.sum())

    @cached_property
    def _numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        comms, place = _numbered(self.comm)
        return comms, place, np.bincount(place, weights=self.graph.k, minlength=len(comms))

    @cached_property
    def info(self) -> tuple[None, int, float]:
        """The number of communities and the sum of their squared degrees, where ``blocks.State`` has them."""
        degree = self._numbers[2]
        return None, len(degree), float((degree * degree).sum())

    def share(self) -> str:
        """Where the tasks of a sweep read the labels."""
        comms, place, degree = self._numbers
        path = new_name(self.graph.root)
        _put(path, {
            "place": place.astype(np.int32), "comms": comms, "size": np.bincount(place, minlength=len(comms)), "degree": degree,
            "prev": self.prev, "p": self.p, "active": self.flags,
        })
        _, _ = self.info, self.__dict__.pop("_numbers")  # a sweep is all they are for
        return path


class Laid:
    """A level: blocks in files, vertices and their degrees in order here."""

    def __init__(self, spark: SparkSession, root: str, found: list):
        found = sorted(found, key=lambda x: x.block)
        self.spark, self.root, self.paths = spark, root, [x.path for x in found]
        self.v = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.v, np.int64) for x in found]])
        self.k = np.concatenate([np.zeros(0), *[np.frombuffer(x.k) for x in found]])
        self.n, self.half_edges, self.total = len(self.v), sum(x.n for x in found), float(self.k.sum())
        self.vertices = new_name(root)
        _put(self.vertices, self.v)

    def start(self) -> State:
        return State(self, self.v, self.v)

    def assign(self, state: State) -> State:
        return state

    def sweep(self, state: State, rule: Rule) -> State:
        vertices, labels, paths = self.vertices, state.share(), self.paths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    target, e, p, active = _swept(paths[i], vertices, labels, rule)
                    data = pickle.dumps((target, e, p, active), protocol=5)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data], pa.binary())], names=["i", "data"])

        n = len(paths)
        if n == 1:  # starting a job would take longer
            out = [_swept(paths[0], vertices, labels, rule)]
        else:
            rows = _numbers(self.spark, n).mapInArrow(run, "i long, data binary").toArrow()
            by = dict(zip(rows["i"].to_pylist(), rows["data"]))
            out = [pickle.loads(by[i].as_buffer()) for i in range(n)]
        _drop(labels)
        join = lambda i: None if out[0][i] is None else np.concatenate([x[i] for x in out])
        return State(self, join(0), state.comm, join(2), join(3), sum(x[1] for x in out))

    def contract(self, label: np.ndarray, count: int) -> Laid | None:
        """The level whose vertices are the communities 0 .. count-1 that ``label`` has for each vertex."""
        root, labels, vertices, paths = new_path(self.spark, "level"), new_name(self.root), self.vertices, self.paths
        _put(labels, label)
        degree = np.bincount(label, weights=self.k, minlength=count)
        # at most so many half-edges as now, or a pair each
        blocks = max(1, -(-min(self.half_edges, count * count) // BLOCK))
        bounds = _bounds(np.cumsum(degree), np.arange(count), blocks)
        n, most = len(paths), DEALT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _dealt(_contracted([paths[i] for i in batch.column(0).to_pylist()], vertices, labels), bounds, most)

        after = _laid(self.spark, _numbers(self.spark, n).mapInArrow(run, "block int, data binary"), root, bounds)
        _drop(self.root)
        return after


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """0 .. n-1, a few to a task: starting one takes as long as scoring a block."""
    return spark.range(0, n, 1, max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // 8)))))


def _bounds(upto: np.ndarray, at: np.ndarray, blocks: int) -> np.ndarray:
    """The first keys of all blocks but the first; ``upto`` is the running weight along the keys ``at``."""
    if not len(at):
        return np.zeros(0, np.int64)
    cut = np.searchsorted(upto, upto[-1] * np.arange(1, blocks) / blocks)
    return np.unique(at[np.minimum(cut, len(at) - 1)])


def _laid(spark: SparkSession, shares: DataFrame, root: str, bounds: np.ndarray) -> Laid | None:
    largest = LARGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _lay(batches, root, largest)

    found = shares.repartitionById(len(bounds) + 1, F.col("block")).mapInArrow(run, LAID).collect()
    if any(x.path is None for x in found) or sum(len(x.v) for x in found) > 8 * MOST:
        return None
    return Laid(spark, root, found)


def lay_out(source: Source) -> Laid | None:
    """The first level; nothing if it is too large for the driver or a block of it for a task.

    A sample of keys says where blocks should end; all rows are laid out.
    """
    rows, key, make = source.rows, source.key, source.make
    spark, count = rows.sparkSession, rows.count()
    share = min(1.0, SAMPLE / max(count, 1))
    drawn = rows if share == 1.0 else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    parts, seen = [], 0
    for part in make(iter(drawn.toArrow().sort_by(key).to_batches())):
        parts.append(part[0])
        seen += len(part[0])
        if seen > DEALT << 2:
            break
    src = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))
    blocks = max(1, round(len(src) / share / BLOCK))
    bounds, most = _bounds(np.arange(1, len(src) + 1), src, blocks), DEALT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(make(batches), bounds, most)

    together = rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, "block int, data binary")
    return _laid(spark, together, new_path(spark, "level"), bounds)


def renumbered(comm: np.ndarray) -> tuple[np.ndarray, int]:
    """Communities as 0 .. k-1 by their first vertex, for each vertex, and k."""
    ids, first, at = np.unique(comm, return_index=True, return_inverse=True)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(first)] = np.arange(len(ids))
    return rank[at], len(ids)
