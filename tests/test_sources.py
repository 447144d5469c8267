"""One tiny file per format, with the awkward lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import build
from weftgraph.sources import csr, text
from weftgraph.streaming.degrees import streaming_degrees


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content.encode())
    return str(p)


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "w").collect())


def test_edge_lists(spark, tmp_path):
    p = put(tmp_path, "a.txt", "# c\n% c\r\n\n0 1\r\n1\t2 -3\n2 2 1\n0 1 5\n9 4")
    want = [(0, 1, 1.0), (1, 2, 3.0), (2, 2, 1.0), (0, 1, 5.0), (9, 4, 1.0)]
    assert rows(text.read_edge_list(spark, p)) == sorted(want + [(b, a, w) for a, b, w in want])
    assert rows(text.read_edge_list(spark, p, directed=False)) == sorted(want)
    assert rows(text.read_edge_list(spark, p, directed=False, policy="original"))[2] == (1, 2, -3.0)
    assert rows(text.read_edge_list(spark, p, directed=False, base=1, policy="one"))[0] == (-1, 0, 1.0)
    random = rows(text.read_edge_list(spark, p, policy="random", seed=3))
    assert all(0.01 <= w < 1 for *_, w in random)
    assert {(a, b): w for a, b, w in random}[1, 2] == {(a, b): w for a, b, w in random}[2, 1]


def test_evalue(spark, tmp_path):
    p = put(tmp_path, "e.tsv", "B\tA\t1e-3\nC\tB\t0.5\nA\tD\t2e-3\n\n")
    edges, ids = text.read_evalue(spark, p, 0.1)
    assert {r.key: r.id for r in ids.collect()} == {"B": 0, "A": 1, "D": 2}
    assert rows(edges) == sorted([(0, 1, 1e-3), (1, 0, 1e-3), (1, 2, 2e-3), (2, 1, 2e-3)])


def test_snap(spark, tmp_path):
    p = put(tmp_path, "s.txt", "# Nodes: 3 Edges: 2\n30 20\n20 10")
    edges, ids = text.read_snap(spark, p)
    assert {r.old_id: r.new_id for r in ids.collect()} == {30: 0, 20: 1, 10: 2}
    assert rows(edges) == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    assert text.snap_header(spark, p) == (3, 2)


def test_dimacs(spark, tmp_path):
    p = put(tmp_path, "d.gr", "c x\np sp 3 3\na 1 2 5\na 1 2 9\na 2 1 7\na 3 3 -2")
    assert rows(text.read_dimacs(spark, p)) == [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 2.0)]
    assert rows(text.read_dimacs(spark, p, directed=False)) == [(0, 1, 5.0), (1, 0, 7.0), (2, 2, 2.0)]


def test_metis(spark, tmp_path):
    p = put(tmp_path, "m.graph", "% c\n3 2\n2\n% inside\n1 3\n2")
    assert rows(text.read_metis(spark, p)) == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    p = put(tmp_path, "w.graph", "4 2 11\n7 2 5\n7 1 5 3 6\n7 2 6\n7")
    assert rows(text.read_metis(spark, p)) == [(0, 1, 5.0), (1, 0, 5.0), (1, 2, 6.0), (2, 1, 6.0)]


def test_matrix_market(spark, tmp_path):
    p = put(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 3\n2 1 1.5\n3 2 2.0\n3 3 4")
    assert rows(text.read_matrix_market(spark, p)) == [(0, 1, 1.5), (1, 0, 1.5), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 4.0)]
    p = put(tmp_path, "b.mtx", "%%MatrixMarket matrix coordinate pattern general\n3 3 1\n2 1\n")
    assert rows(text.read_matrix_market(spark, p)) == [(1, 0, 1.0)]
    assert rows(text.read_matrix_market(spark, p, symmetrize=True)) == [(0, 1, 1.0), (1, 0, 1.0)]
    p = put(tmp_path, "c.mtx", "%%MatrixMarket matrix coordinate complex general\n3 3 1\n2 1 4 7\n")
    assert rows(text.read_matrix_market(spark, p)) == [(1, 0, 4.0)]
    with pytest.raises(ValueError):
        text.read_matrix_market(spark, put(tmp_path, "d.mtx", "%%MatrixMarket matrix array real general\n1 1\n"))


def test_pajek(spark, tmp_path):
    p = put(tmp_path, "p.net", "*Vertices 5\n*Edges\n1 2\n2 1\n5 2\n6 1\n")
    edges, ids = text.read_pajek(spark, p)
    assert {r.old_id: r.new_id for r in ids.collect()} == {0: 0, 1: 1, 4: 2}
    assert rows(edges) == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    out = str(tmp_path / "map")
    text.write_mapping(ids, out)
    assert [r.value for r in spark.read.text(out).orderBy("value").collect()] == ["0 0", "1 1", "4 2"]


def test_shards(spark, tmp_path):
    d = tmp_path / "shards"
    d.mkdir()
    (d / "1__1.csv").write_text("ai,aj,common,jaccard\n0,1,4,0.5\n1,1,2,0.25\n")
    (d / "1__2.csv").write_text("ai,aj,common,jaccard\n0,3,4,0.75\n")
    (d / "3__3.csv").write_text("ai,aj,common,jaccard\n0,3,4,0.75\n")
    plain, _ = text.read_shards(spark, str(d), 1, 2, 10, compact=False)
    assert rows(plain) == [(0, 1, 0.5), (0, 13, 0.75), (1, 0, 0.5), (1, 1, 0.25), (13, 0, 0.75)]
    edges, ids = text.read_shards(spark, str(d), 1, 2, 10)
    assert {r.old_id: r.new_id for r in ids.collect()} == {0: 0, 1: 1, 13: 2}
    assert rows(edges) == [(0, 1, 0.5), (0, 2, 0.75), (1, 0, 0.5), (1, 1, 0.25), (2, 0, 0.75)]


def test_truth_and_communities(spark, tmp_path):
    p = put(tmp_path, "t.txt", "2 1\r\n1 1\n3\t2")
    truth = text.read_ground_truth(spark, p, base=1)
    assert {r.v: r.comm for r in truth.collect()} == {1: 0, 2: 0, 3: 1}
    out = str(tmp_path / "comm")
    text.write_communities(truth, out)
    assert [r.value for r in text.numbered_lines(spark, out).orderBy("line_no").collect()] == ["0", "0", "1"]


@pytest.mark.parametrize("bits", [64, 32])
def test_csr_round_trip(spark, tmp_path, bits):
    pairs = [(a, (a * 7 + 1) % 50, float(a % 4)) for a in range(50)] + [(3, 3, 2.0)]
    edges = build.symmetrize(spark.createDataFrame(pairs, "src long, dst long, w double"), "once")
    path = str(tmp_path / "g.bin")
    csr.write_csr(edges, path, 60, bits)  # ten isolated vertices
    assert csr.read_header(path, bits) == (60, edges.count())
    for balanced in (False, True):
        assert rows(csr.read_csr(spark, path, parts=7, balanced=balanced, bits=bits)) == rows(edges)
    assert {r.w for r in csr.read_csr(spark, path, ones=True, bits=bits).collect()} == {1.0}


def test_adjacency_and_stream(spark, tmp_path):
    edges = spark.createDataFrame([(0, 2, 1.0), (0, 1, 2.0), (1, 0, 2.0)], "src long, dst long, w double")
    assert [tuple(map(tuple, (r.tails, r.weights))) for r in build.csr_rows(edges).orderBy("v").collect()] == [((1, 2), (2.0, 1.0)), ((0,), (2.0,))]
    edges.write.parquet(str(tmp_path / "in"))
    stream = streaming_degrees(spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    want = {r.v: r.k for r in edges.select(F.explode(F.array("src", "dst")).alias("v"), "w").groupBy("v").agg(F.sum("w").alias("k")).collect()}
    assert {r.v: r.k for r in spark.table("deg").collect()} == want


def test_csr_hub_is_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csr, "SPAN", 16)
    pairs = [(0, v, float(v)) for v in range(1, 400)] + [(7, 3, 1.5), (7, 3, 0.5), (399, 399, 2.0)]
    edges = build.symmetrize(spark.createDataFrame(pairs, "src long, dst long, w double"), "once").repartition(5)
    path = str(tmp_path / "hub.bin")
    csr.write_csr(edges, path, 400, part_edges=37)
    import numpy as np

    raw = (tmp_path / "hub.bin").read_bytes()
    nv, ne = np.frombuffer(raw[:16], "<i8")
    offsets = np.frombuffer(raw[16 : 16 + 8 * (nv + 1)], "<i8")
    want = rows(edges)
    tail = np.frombuffer(raw[16 + 8 * (nv + 1) :], [("t", "<i8"), ("w", "<f8")])
    assert (nv, ne) == (400, len(want)) and offsets[0] == 0 and offsets[-1] == ne
    assert [(v, int(t), float(w)) for v in range(nv) for t, w in tail[offsets[v] : offsets[v + 1]]] == want
    empty = str(tmp_path / "none.bin")
    csr.write_csr(edges.limit(0), empty, 3)
    assert csr.read_header(empty) == (3, 0) and csr.read_csr(spark, empty).count() == 0
    with pytest.raises(ValueError):
        csr.write_csr(edges, "mock://x/y", 400)


def test_adjacency_lists_are_cut(spark):
    edges = spark.createDataFrame([(0, v, 1.0) for v in range(100)], "src long, dst long, w double")
    got = build.csr_rows(edges, span=30).orderBy("part").collect()
    assert [len(r.tails) for r in got] == [30, 30, 30, 10] and [t for r in got for t in r.tails] == list(range(100))


def test_a_cluster_must_name_the_shared_folder(spark):
    from weftgraph.plans import stage

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("local-cluster[3,2,1000]", "yarn", "spark://h:7077", ""):
        with pytest.raises(ValueError):
            stage.shared_dir(Session(spark_master=master))
    assert stage.shared_dir(Session(spark_master="local[8]")).startswith("file://")
