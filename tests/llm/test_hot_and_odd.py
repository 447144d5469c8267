"""One key or text with most of the rows, and odd, empty and clashing tables, for each operator."""

from __future__ import annotations

import collections
import hashlib
import itertools
import pathlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import ann, chat, html_extract, mixing, packing, quality, queries, simhash, warc
from weftgraph.plans.stage import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def spread(spark):
    """Partitions are not merged, so that small tables are in several ranges."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def tasks(df):
    """Rows of the fullest task, all rows."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n), sum(n)


# --- 4 --------------------------------------------------------------------------


def test_mix_clash_and_empty(spark):
    rows = [(1, "a b c", "x", "s", 5), (1, "a b c", "x", "s", 5), (2, None, None, None, None), (3, "d " * 9, "y", "t", 18)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS key", "2 AS size", "3 AS taken", "4 AS target", "5 AS rows", "6 AS place")
    plan = mixing.mix(frame)
    assert sorted((r.doc_id, r.size) for r in plan.collect()) == [(1, 3), (1, 3), (2, 0), (3, 9)]
    out = mixing.take(frame, plan).collect()
    assert sum(len((r.text or "").split()) for r in out) == plan.agg(F.sum("taken")).first()[0]
    assert {(r.key, r.size, r.taken) for r in out} == {(1, 2, 3)}
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.take(frame.limit(0), mixing.mix(frame.limit(0))).count() == 0


def test_take_of_repeated_rows_gives_each_its_share(spark):
    rows = [(7, "w " * 10, None, "s", 20)] * 9 + [(i, "v " * 7, None, "s", 14) for i in range(5)] + [(None, "", None, "s", 0)] * 40 + [(9, "z " * 200, None, "t", 400)]
    frame = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix(frame, mixing.MixParams(share=0.4))
    want = collections.Counter((r.doc_id, r.taken) for r in plan.collect() if r.taken)
    out = mixing.take(frame, plan).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in out} == {k: sum(t * n for (d, t), n in want.items() if d == k) for k in {d for d, _ in want}}


# --- 5 --------------------------------------------------------------------------


def test_search_beats_best_fit_and_ends_at_an_optimum():
    rng = np.random.default_rng(0)
    a = rng.integers(257, 420, 400)
    b = rng.integers(257, 1024 - a - 256)
    lengths = np.concatenate([a, b, 1024 - a - b])  # three a bin, in 400 bins
    first = packing.best_fit(lengths, 1024)
    found = packing.improve([list(x) for x in first], lengths, 1024)
    assert sorted(i for x in found for i in x) == list(range(1200)) and max(lengths[x].sum() for x in found) <= 1024
    assert len(found) < 0.95 * len(first)
    fill = [int(lengths[x].sum()) for x in found]
    for x, y in itertools.permutations(range(len(found)), 2):  # nothing is left to carry from x into a fuller y
        if fill[x] > fill[y] or fill[y] == 1024:
            continue
        room, p, q = 1024 - fill[y], lengths[found[x]], lengths[found[y]]
        assert p.min() > room
        one = p[:, None] - q[None, :]
        pairs = np.array([s + t for s, t in itertools.combinations(p, 2)] or [0])[:, None] - q[None, :]
        apart = p[:, None] - np.array([s + t for s, t in itertools.combinations(q, 2)] or [2048])[None, :]
        for gain in (one, pairs, apart):
            assert not ((gain > 0) & (gain <= room)).any()


def test_search_is_exact_on_small_cases():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array([rng.randrange(1, 10) for _ in range(rng.randrange(1, 9))])
        found = packing.improve(packing.best_fit(lengths, 10), lengths, 10)
        best = next(k for k in range(1, 10) if any(max((sum(lengths[i] for i in range(len(lengths)) if c[i] == b) for b in range(k)), default=0) <= 10 for c in itertools.product(range(k), repeat=len(lengths))))
        assert best <= len(found) <= best + (len(lengths) > 6) and sorted(i for x in found for i in x) == list(range(len(lengths)))


def test_repeated_pieces_are_dealt_evenly(spark):
    pieces = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    out = materialize(packing.pack(pieces, packing.PackParams(queries.TOKENIZER, group_pieces=2000)), "packed")
    sizes = [r["count"] for r in out.groupBy((F.col("sequence_id") / 2**32).cast("long").alias("g")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2400
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("o")).filter("n > 1024 OR o <> n - 1").count() == 0
    plan = packing.pack(pieces, packing.PackParams(queries.TOKENIZER))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # dealt by range, one group a task


def test_other_tokenizer_files_use_the_named_library(tmp_path):
    import json

    with open(queries.TOKENIZER, encoding="utf-8") as f:
        file = json.load(f)
    assert packing.byte_ranks(queries.TOKENIZER) is not None
    changes = [
        {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {**file["pre_tokenizer"], "use_regex": False}},
        {"added_tokens": [{**file["added_tokens"][0], "special": False}]}, {"pre_tokenizer": None}, {"model": {**file["model"], "ignore_merges": True}},
    ]
    for i, change in enumerate(changes):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps({**file, **change}), encoding="utf-8")
        assert packing.byte_ranks(str(path)) is None


# --- 6 and 7 ---------------------------------------------------------------------


def test_edited_fingerprints_over_ranges(spark, spread):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(30)) for _ in range(rng.randrange(9)))) for i in range(0, 300, 3)] + [(-5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS range", "2 AS edge", "3 AS prints").repartition(5)
    got = {r.doc_id: r for r in simhash.edited_fingerprints(frame).collect()}
    order, of = sorted((k, t or "") for k, t in rows), simhash.TermFingerprint()
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        g = got[k]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (of(t).hex(), of(edit).hex())
        assert (g.near_edited, g.near_next) == (simhash.likeness(of(t), of(edit)), simhash.likeness(of(t), of(nxt)))
        assert [x & (1 << 64) - 1 for x in g.prints] == [int(g.fingerprint[:16], 16), int(g.fingerprint[16:], 16)]
    assert simhash.edited_fingerprints(frame.limit(0)).count() == 0


def test_many_partitions_of_few_documents_make_few_files(spark, spread, tmp_path):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    few = {tuple(r) for r in queries.op6_fingerprint(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    before = set(shared.glob("*/part-*"))
    queries.op6_fingerprint(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    assert len(set(shared.glob("*/part-*")) - before) <= 3  # two of fingerprints, one of the ends of ranges
    assert len(list((tmp_path / "out").glob("part-*"))) <= 8
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == few and len(few) == 1500


def test_repeated_rows_fill_several_ranges(spark, spread):
    same = spark.createDataFrame([(5, "a b c")] * 3000 + [(i, str(i)) for i in range(20)], "doc_id long, text string").repartition(4)
    out = simhash.edited_fingerprints(same)
    most, every = tasks(out)
    assert every == 3020 and most < 1200
    assert out.filter("doc_id = 5 AND near_next = 1").count() == 2999
    empty = simhash.edited_fingerprints(spark.createDataFrame([(None, None)] * 50, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_chars, r.fingerprint, r.near_next) for r in empty} == {(None, 0, "0" * 32, 1.0)} and len(empty) == 50


def test_block_tables_find_all_fingerprints_of_documents(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(8)]
    texts = [t for b in base for t in [b] + [" ".join(w for i, w in enumerate(b.split()) if i != j) for j in range(25)]] + ["", "", base[0]]
    rows = simhash.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    of = simhash.TermFingerprint()
    prints = {i: int(of(t).hex(), 16) for i, t in enumerate(texts)}
    some = 0
    for params in (simhash.TableParams(3, 128, 5), simhash.TableParams(6, 128, 8)):
        got = {r.doc_id: r.n_near for r in simhash.with_near(rows, F.col("doc_id") % 5 == 0, params).collect()}
        for i, p in prints.items():
            want = len({q for q in prints.values() if q != p and (p ^ q).bit_count() <= params.radius})
            assert got[i] == (want if i % 5 == 0 else None)
            some += want
    assert some > 50
    lanes = rows.select("prints").distinct()
    dist = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    every = sorted({tuple(r.prints) for r in lanes.collect()})
    want = {(a, b) for a, b in itertools.combinations(every, 2) if dist(a, b) <= 6}
    got = [(tuple(r.a), tuple(r.b)) for r in simhash.near_pairs(lanes, simhash.TableParams(6, 128, 8), "prints").collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == want


def test_dedup_clash_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS text_key", "4 AS component_id", "5 AS node")
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()))) == sorted(map(str, [(1, 1), (2, 1), (None, None), (None, None)]))
    kept = simhash.representatives(frame).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"] and {(r.fp, r.root) for r in kept} == {(1, 2)}
    assert simhash.near_duplicates(frame.limit(0)).count() == simhash.representatives(frame.limit(0)).count() == 0


# --- 8 --------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [3000, 9000])
def test_ann_partitions_follow_the_table(spark, monkeypatch, rows):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 16))
    x = (centre[rng.integers(60, size=rows)] + 0.4 * rng.normal(size=(rows, 16))).astype("float32")
    routers, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: routers.append(fit(*a)) or routers[-1])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(frame, F.col("vec_id") % 100 == 0, ann.AnnParams(part_rows=250, sample=2000, part_sample=40)).toPandas()
    assert routers[0].parts == {3000: 16, 9000: 64}[rows] and routers[0].probes < routers[0].parts / 2
    d, hit = x.astype("float64"), 0
    for q, g in got.groupby("query_id"):
        s = d @ d[q]
        hit += len(set(g["vec_id"]) & set([i for i in np.argsort(-s)[:21] if i != q][:20]))
    assert hit >= 0.9 * len(got) and len(got) == 20 * rows // 100


def test_equal_vectors_make_no_large_block(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(4000)] + [(4000 + i, [float(i % 7 + 1), 1.0, 0.0]) for i in range(200)] + [(3, [1.0, 2.0, 3.0])] * 50
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, F.col("vec_id") % 100 == 0, ann.AnnParams(k=4)).toPandas()
    assert [list(g["vec_id"]) for q, g in got.groupby("query_id") if q in (0, 100)] == [[1, 2, 3, 4], [0, 1, 2, 3]]
    assert got.groupby("query_id").size().eq(4).all() and len(got) == 4 * 42


def test_a_block_comes_before_its_queries():
    v = lambda *x: np.array(x, dtype=float)
    rows = [(0, 0, 0, False, 1, v(1, 0)), (0, 0, 0, False, 2, v(0, 1)), (0, 0, 0, True, 9, v(2, 1)), (0, 1, 0, True, 9, v(2, 1)), (1, 0, 0, False, 3, v(1, 1)), (1, 0, 0, True, 3, v(1, 1)), (1, 0, 0, True, 8, v(5, 5))]
    rows = [(*r, None if r[3] else r[0], [r[0]] if r[3] else None) for r in rows]
    cols = ["region", "salt", "chunk", "asks", "vec_id", "vec", "part", "probes"]
    for step in (1, 2, 7):
        batches = [pd.DataFrame(rows[i : i + step], columns=cols) for i in range(0, len(rows), step)]
        got = pd.concat(list(ann.blocks_of(iter(batches), 20)))
        assert [tuple(r) for r in got.itertuples(index=False)] == [(9, 1, 2.0), (9, 2, 1.0), (8, 3, 10.0)]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_a_region_is_searched_in_the_probed_partitions_only(k):
    rng = np.random.default_rng(k)
    x = rng.integers(-3, 4, (90, 4)).astype(float)  # many ties
    ids, part = rng.integers(0, 60, 90), np.sort(rng.choice([1, 3, 5, 7, 11], 90))
    q, q_id = rng.integers(-3, 4, (40, 4)).astype(float), rng.integers(0, 60, 40)
    probes = [rng.choice([1, 3, 4, 5, 7, 11, 15], rng.integers(0, 7), replace=False) for _ in q]
    for most in (7, 100):
        got = list(zip(*ann.nearest(q_id, q, probes, ann.Block.of(ids, x, part, most), k)))
        want = []
        for i in range(len(q)):
            found = sorted((-float(x[j] @ q[i]), ids[j]) for j in range(90) if part[j] in probes[i] and ids[j] != q_id[i])
            want += [(q_id[i], c, -s) for s, c in found[:k]]
        assert got == want


def test_regions_change_no_result(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    base = dict(part_rows=100, sample=1000)
    of = lambda **kw: sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0, ann.AnnParams(**base, **kw)).collect()))
    whole = of()
    assert whole == of(region_bytes=2000, query_rows=30) and len(whole) == 2000


# --- 9 --------------------------------------------------------------------------


def plain_posterior(rows, grades, w, scale, theta, l2):
    f = np.array([(w * scale)[r].sum() for r in rows])
    s = np.column_stack([np.ones(len(f)), *(1 / (1 + np.exp(-(f - t))) for t in theta), np.zeros(len(f))])
    return np.log(s[np.arange(len(f)), grades] - s[np.arange(len(f)), grades + 1]).sum() - 0.5 * l2 * (w**2).sum()


def test_quality_fit_is_the_best_cumulative_link(spark):
    rng = np.random.default_rng(3)
    params = quality.QualityParams(bits=4, min_rows=1, steps=3000)
    truth = rng.normal(size=16)
    rows = [np.unique(rng.integers(0, 16, 5)) for _ in range(400)]
    noisy = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=400)
    grades = (noisy > -0.5).astype(int) + (noisy > 1.0).astype(int)
    model = quality.fit(rows, grades, params)
    # each feature's scale, from its counts
    good = grades >= params.good
    n1 = np.array([sum(i in r for r, g in zip(rows, good) if g) for i in range(16)])
    n0 = np.array([sum(i in r for r, g in zip(rows, good) if not g) for i in range(16)])
    odds = np.log((n1 + 0.5) / (good.sum() + 1)) - np.log((n0 + 0.5) / ((~good).sum() + 1))
    scale = np.maximum(np.abs(odds) - np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)), 0)
    w = np.divide(model.weights, scale, out=np.zeros(16), where=scale > 0)
    best = plain_posterior(rows, grades, w, scale, model.thresholds, params.l2)
    for step in (0.05, 0.2):  # no other weight or threshold is better
        for i in range(16):
            for d in (step, -step):
                assert plain_posterior(rows, grades, w + d * (np.arange(16) == i), scale, model.thresholds, params.l2) <= best + 1e-3
        for i in range(2):
            for d in (step, -step):
                assert plain_posterior(rows, grades, w, scale, model.thresholds + d * (np.arange(2) == i), params.l2) <= best + 1e-3
    assert model.thresholds[0] < model.thresholds[1]


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 2), (1, 2), (1, 0), *((i, i % 3) for i in range(2, 60))], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, grades, params: seen.append(len(rows)))
    quality.train(docs, labels)
    quality.train(docs, labels, quality.QualityParams(sample=10))
    assert seen == [60, 10]


# --- 2 and 10 ---------------------------------------------------------------------


def test_chat_and_archives_of_nothing(spark):
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    assert chat.digests(chat.format_conversations(chats, chat.ChatParams(queries.TOKENIZER))).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>" + "x" * 2000)] * 2 + [(None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest", "3 AS refers_to")
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type) for r in warc.archive_pages(spark, pages).collect())))
    assert got == sorted(map(str, [(1, 2003, "response"), (1, 2003, "response"), (None, 0, "response")]))
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_large_ids_stay_exact_beside_nulls(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b c"), (None, "d e f"), (big + 1, "g h i")], "doc_id long, text string").coalesce(1)
    ids = {big, None, big + 1}
    assert {r.doc_id for r in packing.pack_documents(docs, packing.PackParams(queries.TOKENIZER)).collect()} == ids
    assert {r.doc_id for r in simhash.edited_fingerprints(docs).collect()} == ids
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == ids
    assert {r.doc_id for r in quality.score(docs, quality.train(docs, docs.select("doc_id", F.lit(2).alias("grade")).limit(0))).collect()} == ids
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert {r.conv_id for r in chat.digests(chat.format_conversations(turns, chat.ChatParams(queries.TOKENIZER))).collect()} == ids
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id for r in warc.archive_pages(spark, pages).collect()} == ids
    assert {r.page_id for r in html_extract.extract(pages).collect()} == ids
