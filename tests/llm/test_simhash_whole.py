"""Near-dedup keeps one row of each group, whatever the ids."""

from __future__ import annotations

import random

from weftgraph.llm import simhash

DOCS = "doc_id long, text string"


def words(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in simhash.representatives(spark.createDataFrame(rows, DOCS)).collect()), key=str)


def test_null_ids_keep_every_group(spark):
    rows = [(None, words(i)) for i in range(20)] + [(1, words(100))]
    assert kept(spark, rows) == sorted(rows, key=str)
    # exact copies and a group with an id
    more = rows + rows[:5] + [(None, words(100)), (None, None), (None, "")]
    got = kept(spark, more)
    assert len(got) == 22 and (1, words(100)) in got and (None, words(100)) not in got


def test_repeated_ids_keep_every_group(spark):
    a, b, c = words(1), words(2), words(3)
    assert kept(spark, [(4, a), (4, b), (1, b), (4, c), (4, c)]) == sorted([(4, a), (1, b), (4, c)], key=str)


def test_first_text_of_the_smallest_id_stays(spark):
    a = words(1)
    near = [a.replace(" ", "  ", n) for n in (1, 2, 3)]
    assert kept(spark, [(7, a), (7, near[0]), (7, near[1]), (9, near[2])]) == [(7, min(a, near[0], near[1]))]
