"""The stages of the pipeline on small tables."""

from __future__ import annotations

import corpus_pipeline
import pandas as pd

from weftgraph.llm import mixing, quality, queries, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_what_they_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "mixing sources", "best-fit packing"]
    good = corpus_pipeline.keep_good(spark, docs, SMALL)
    assert good.columns == docs.columns
    scored = quality.score(docs, quality.train(docs, queries.graded(spark, SMALL)))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.filter("keep").collect()}
    single = corpus_pipeline.drop_near_copies(spark, good, SMALL)
    assert single.columns == docs.columns
    marks = simhash.near_duplicates(good).toPandas()
    assert {r.doc_id for r in single.collect()} == set(marks["component_id"])
    mixed = corpus_pipeline.mix_sources(spark, single, SMALL)
    assert mixed.columns == docs.columns
    assert set(mixed.toPandas()["doc_id"]) == set(mixing.mix(single).filter("taken > 0").toPandas()["doc_id"])
    packed = corpus_pipeline.pack_sequences(spark, mixed, SMALL).toPandas()
    assert set(packed["doc_id"]) == set(mixed.toPandas()["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(out) and isinstance(out, pd.DataFrame)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use themselves.
CLASH = ("size", "taken", "target", "fp", "root", "component_id", "key", "rows", "keep", "expected_grade", "piece", "length", "text_key", "grade", "part")


def odd(spark):
    good = "The long road from the hills to the coast was quiet that morning, and the children walked along it."
    rows = [(i, f"{good} {i} {i * 7}", "en", "s1" if i % 2 else None, None) for i in range(6)]
    rows += [(None, None, None, None, None), (None, "", "en", "s2", 0), (50, " \n", None, "s2", 3), (51, good, "en", "s2", 9), (51, good, "en", "s2", 9), (None, good + " x", "en", "s1", 9)]
    rows += [(52, "word and more of it " * 20_000, "en", "s1", 400_000), (2, good + " and then", "de", "s1", None)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.selectExpr("*", *(f"{i} AS {c}" for i, c in enumerate(CLASH)))


def same(rows):
    return sorted(map(repr, rows))


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    plain = [tuple(r) for r in docs.collect()]
    good = corpus_pipeline.keep_good(spark, docs, SMALL)
    assert good.columns == docs.columns and set(map(repr, map(tuple, good.collect()))) <= set(map(repr, plain))
    single = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert single.columns == docs.columns
    # one row of each component, by brute force over pairs
    prints = [simhash.shingle_fingerprint(r[1]) for r in plain]
    group = list(range(len(plain)))
    for i in range(len(plain)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, plain):
        k = (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
        if g not in best or k < best[g][0]:
            best[g] = (k, r)
    assert same(tuple(r)[:2] for r in single.collect()) == same(r[:2] for _, r in best.values())
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    taken = mixing.mix(docs).toPandas()["taken"].sum()
    out = mixed.collect()
    assert sum(len(r.text.split()) for r in out) == taken and {tuple(r)[5:] for r in out} == {tuple(range(len(CLASH)))}
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL).toPandas()
    assert (packed["piece"] == 0).sum() == len(plain) and packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_stages_on_nothing(spark):
    empty = odd(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
