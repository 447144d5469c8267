"""Binary CSR files: ``nv i64, ne i64, offsets i64[nv+1], (tail i64, w f64)[ne]``.

A Python data source with one partition a vertex range reads only its own
offsets and edges; the writer computes the place of every edge first, and
executors write them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.functions.prefix import ranged_total
from weftgraph.operators.build import csr_offsets
from weftgraph.plans.stage import materialize

SCHEMA = "src long, dst long, w double"
CHUNK = 1 << 20


def _dtypes(bits: int) -> tuple[np.dtype, np.dtype]:
    if bits == 32:
        return np.dtype("<i4"), np.dtype([("tail", "<i4"), ("w", "<f4")])
    return np.dtype("<i8"), np.dtype([("tail", "<i8"), ("w", "<f8")])


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(inner)


def read_header(path: str, bits: int = 64) -> tuple[int, int]:
    word, _ = _dtypes(bits)
    with _open(path) as f:
        return tuple(int(x) for x in np.frombuffer(f.read(2 * word.itemsize), word))


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    def __init__(self, path: str, parts: int, bits: int, balanced: bool, ones: bool) -> None:
        self.path, self.parts, self.bits, self.balanced, self.ones = path, parts, bits, balanced, ones

    def partitions(self) -> list[Range]:
        nv, ne = read_header(self.path, self.bits)
        if not self.balanced:
            cuts = [nv * j // self.parts for j in range(self.parts + 1)]
        else:  # binary search in the offsets on disk: a few reads a cut, no pass
            cuts = [0, *(self._vertex_at(nv, ne * j // self.parts) for j in range(1, self.parts)), nv]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def _vertex_at(self, nv: int, edge: int) -> int:
        word, _ = _dtypes(self.bits)
        lo, hi = 0, nv
        with _open(self.path) as f:
            while lo < hi:
                mid = (lo + hi) // 2
                f.seek(2 * word.itemsize + mid * word.itemsize)
                if int(np.frombuffer(f.read(word.itemsize), word)[0]) < edge:
                    lo = mid + 1
                else:
                    hi = mid
        return lo

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        word, edge = _dtypes(self.bits)
        nv, _ = read_header(self.path, self.bits)
        a, b = partition.first, partition.last
        base = 2 * word.itemsize
        with _open(self.path) as f:
            f.seek(base + a * word.itemsize)
            offsets = np.frombuffer(f.read((b - a + 1) * word.itemsize), word).astype("int64")
            start = base + (nv + 1) * word.itemsize
            for lo in range(int(offsets[0]), int(offsets[-1]), CHUNK):
                hi = min(lo + CHUNK, int(offsets[-1]))
                f.seek(start + lo * edge.itemsize)
                rows = np.frombuffer(f.read((hi - lo) * edge.itemsize), edge)
                src = np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1 + a
                w = np.ones(hi - lo) if self.ones else rows["w"].astype("float64")
                yield pa.RecordBatch.from_arrays([pa.array(src.astype("int64")), pa.array(rows["tail"].astype("int64")), pa.array(w)], names=["src", "dst", "w"])


class CsrSource(DataSource):
    """``spark.read.format("csr").option("parts", 8).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        o = self.options
        flag = lambda k: str(o.get(k, "false")).lower() == "true"
        return CsrReader(o["path"], int(o.get("parts", 8)), int(o.get("bits", 64)), flag("balanced"), flag("ones"))


def read_csr(spark: SparkSession, path: str, parts: int = 8, balanced: bool = False, ones: bool = False, bits: int = 64) -> DataFrame:
    """Half-edges of a file; ``balanced`` cuts ranges by edges instead of vertices."""
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr").option("parts", parts).option("balanced", balanced).option("ones", ones).option("bits", bits).load(path)


#: Tails of one vertex are counted by spans of so many ids, so that a hub may fill several parts.
SPAN = 1 << 20


def write_csr(edges: DataFrame, path: str, nv: int, bits: int = 64, part_edges: int = 1 << 22) -> None:
    """One file with the edges sorted by (src, dst, w), written at their places by the executors.

    The place of each run (vertex, span of tails) is a distributed prefix sum
    over counts; runs are dealt into parts of about ``part_edges`` edges, and
    a part is sorted and written where it belongs. The driver sees the number
    of edges only. A task that is run again writes the same bytes to the same
    places. ``path`` must be in a file system that driver and executors mount
    alike and that allows writing at a place; Parquet is the sink for others.
    """
    word, edge = _dtypes(bits)
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError(f"cannot write at a place in {path}: use a mounted folder, or Parquet")
    edges = edges.select("src", "dst", "w", F.floor(F.col("dst") / SPAN).alias("span"))
    counts = edges.groupBy("src", "span").agg(F.count(F.lit(1)).alias("n"))
    runs = ranged_total(counts, [F.col("src"), F.col("span")], F.col("n"), "upto")
    runs = materialize(runs.select("src", "span", (F.col("upto") - F.col("n")).cast("long").alias("at"), "n"), "runs")
    ne = int(runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    start = 2 * word.itemsize
    tail = start + (nv + 1) * word.itemsize
    with open(inner, "wb") as f:
        f.write(np.array([nv, ne], word).tobytes())
        f.truncate(tail + ne * edge.itemsize)
        f.seek(tail - word.itemsize)
        f.write(np.array([ne], word).tobytes())

    def put(pieces: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(inner, "r+b") as f:
            for at, raw in pieces:
                f.seek(at)
                n += f.write(raw)
        yield pa.RecordBatch.from_pydict({"bytes": [n]})

    def put_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            last, at = None, 0  # the part that is being written, and its next place
            for batch in batches:
                part, first, dst, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "at", "dst", "w"))
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if part[a] != last:
                        last, at = part[a], int(first[a])
                    rows = np.empty(b - a, edge)
                    rows["tail"], rows["w"] = dst[a:b], w[a:b]
                    yield tail + at * edge.itemsize, rows.tobytes()
                    at += b - a

        yield from put(pieces())

    def put_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                v, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "offset"))
                cuts = [0, *(np.flatnonzero(v[1:] != v[:-1] + 1) + 1).tolist(), len(v)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b:
                        yield start + int(v[a]) * word.itemsize, at[a:b].astype(word).tobytes()

        yield from put(pieces())

    parts = max(1, -(-ne // part_edges))
    placed = edges.join(runs.withColumn("part", F.floor(F.col("at") / part_edges).cast("long")).drop("n"), ["src", "span"])
    dealt = placed.repartition(parts, "part").sortWithinPartitions("part", "src", "dst", "w").select("part", "at", "dst", "w")
    dealt.mapInArrow(put_edges, "bytes long").agg(F.sum("bytes")).collect()
    ids = edges.sparkSession.range(nv).select(F.col("id").alias("v"))
    offsets = csr_offsets(edges, ids).repartitionByRange("v").sortWithinPartitions("v")
    offsets.select("v", "offset").mapInArrow(put_offsets, "bytes long").agg(F.sum("bytes")).collect()
