"""The template tree against a plain one, and branches at any depth."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import queries, url_filter


def plain_tree(rows, p=url_filter.TreeParams()):
    """{(host, segments): template} and {(host, template): purity} of (host, segments, bad) rows, one level after the other."""
    at = {(h, s): "" for h, s, _ in rows}
    for level in range(max((len(s) for _, s, _ in rows), default=0)):
        nodes: dict = {}
        for h, s, bad in rows:
            if len(s) > level:
                node = nodes.setdefault((h, at[h, s]), {})
                c = node.setdefault(s[level], [0, 0, 0])
                c[0] += 1
                c[1] += bad is not None
                c[2] += bad or 0
        star = set()
        for key, node in nodes.items():
            pn, pbad = sum(c[1] for c in node.values()), sum(c[2] for c in node.values())
            rare = sum(c[0] <= p.max_repeat for c in node.values())
            for seg, (count, n, bad) in node.items():
                m = pn - n
                pooled = pbad / max(pn, 1)
                spread = math.sqrt(pooled * (1 - pooled) * (1 / max(n, 1) + 1 / max(m, 1)))
                gap = abs(bad / max(n, 1) - (pbad - bad) / max(m, 1))
                alike = len(node) > 1 and (spread == 0 or n == 0 or m == 0 or gap < p.z * spread)
                if alike or (count <= p.max_repeat and rare >= p.min_children):
                    star.add((*key, seg))
        at = {(h, s): t if len(s) <= level else f"{t}/*" if (h, t, s[level]) in star else f"{t}/{s[level]}" for (h, s), t in at.items()}
    n_all, bad_all = sum(b is not None for *_, b in rows), sum(b or 0 for *_, b in rows)
    prior, leaf = (bad_all + 1) / (n_all + 2), {}
    for h, s, bad in rows:
        c = leaf.setdefault((h, at[h, s]), [0, 0])
        c[0] += bad is not None
        c[1] += bad or 0
    return at, {k: (n, (bad + prior * p.strength) / (n + p.strength)) for k, (n, bad) in leaf.items()}


def labelled(spark, rows):
    frame = spark.createDataFrame([(i, u, i, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, url_key long, bad int")
    return frame.drop("bad"), frame.filter("bad is not null").select("url_key", "bad")


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_a_plain_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        segs, odds = [], 0.2
        for level in range(rng.randrange(1, 9)):
            kind = rng.random()
            seg = rng.choice(["spam", "news", "*", "", "é"]) if kind < 0.5 else f"section{rng.randrange(3)}" if kind < 0.7 else "same" if kind < 0.8 else str(rng.randrange(10**6))
            odds = 0.95 if seg in ("spam", "section1") else odds
            segs.append(seg)
        rows.append((f"http://h{rng.choice([0, 0, 1])}.org/" + "/".join(segs), rng.choice([None, int(rng.random() < odds), int(rng.random() < odds)])))
    pages, labels = labelled(spark, rows)
    got = url_filter.judge(pages, labels, rules=()).collect()
    keyed = []
    for r in sorted(got, key=lambda r: r.page_id):
        path = r.path.removeprefix("/").removesuffix("/") if r.path != "/" else ""
        keyed.append((r.host, tuple("%2A" if s == "*" else s for s in path.split("/")), rows[r.page_id][1]))
    at, purity = plain_tree(keyed)
    blocked = 0
    for r, (h, s, _) in zip(sorted(got, key=lambda r: r.page_id), keyed):
        assert r.template == at[h, s]
        n, want = purity[h, at[h, s]]
        assert r.purity == pytest.approx(want)
        assert r.verdict == ("block" if n and want >= 0.5 else "allow")
        blocked += r.verdict == "block"
    assert 0 < blocked < len(rows)


@pytest.mark.parametrize("depth", [0, 4, 5, 8, 40])
def test_branches_part_at_any_depth(spark, depth):
    lead = "".join(f"/{chr(97 + i % 26)}" for i in range(depth))
    rows = [(f"http://h.org{lead}/{b}/item-{i}", None if i % 3 == 2 else int(b == "section1")) for b in ("section1", "section2") for i in range(60)]
    got = url_filter.judge(*labelled(spark, rows)).collect()
    assert {(r.path.split("/")[depth + 1], r.verdict) for r in got} == {("section1", "block"), ("section2", "allow")}
    assert {r.template for r in got} == {f"{lead}/section1/*", f"{lead}/section2/*"}


def test_frequent_children_among_many_rare_ones_keep_their_branch(spark):
    rows = [("http://h.org/spam/x", 1)] * 300 + [("http://h.org/news/x", 0)] * 300 + [(f"http://h.org/u{i}", None) for i in range(600)]
    got = url_filter.judge(*labelled(spark, rows)).collect()
    assert {r.verdict for r in got if "/spam" in r.path} == {"block"} and {r.verdict for r in got if "/spam" not in r.path} == {"allow"}


def test_odd_urls(spark):
    long = "http://h.org/" + "/".join(f"s{i}" for i in range(5000))
    rows = [(None, 1), ("", 0), (long, 1), (long, 1), (long + "/x", None), ("http://h.org/a", 0), ("http://h.org//", 0)]
    pages, labels = labelled(spark, rows)
    got = url_filter.judge(pages.withColumns({"host": F.lit(1), "__s": F.lit(2)}).drop("__s"), labels).collect()
    rest = "".join(f"/s{i}" for i in range(1, 5000))  # the first segments of the host do not differ by more than chance
    assert len(got) == len(rows) and {r.template for r in got if r.path.count("/") == 5000} == {"/*" + rest}
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_sql_says_the_same(spark):
    d = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        for name in ("pages", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
        want = con.execute(queries.SQL["op1_url_filter"]).df().sort_values("page_id")
    got = queries.op1_url_filter(spark, d).toPandas().sort_values("page_id")
    assert got[["page_id", "verdict", "template", "purity"]].values.tolist() == want[["page_id", "verdict", "template", "purity"]].values.tolist()
