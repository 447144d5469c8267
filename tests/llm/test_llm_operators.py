"""Each operator against a plain reimplementation, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import ann, chat, html_extract, mixing, packing, quality, queries, simhash, url_filter, warc
from weftgraph.plans.stage import new_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


def odd_docs(spark):
    """Nulls, empties, ties, repeated rows and a long text."""
    rows = [(1, "a b c", None, "s1", 5), (2, None, "en", "s1", None), (3, "", "en", None, 0), (4, "a b c", "en", "s2", 5), (4, "a b c", "en", "s2", 5)]
    rows += [(None, "x y z w", "en", "s2", 7), (6, "long word " * 30_000, "en", "s1", 300_000), (7, " \n\t ", "en", "", 4)]
    return spark.createDataFrame(rows, DOCS)


# --- 1 -----------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    best = None
    for rule, says in url_filter.DEFAULT_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, best


def test_urls_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/2?x", "http://b.net/fr/3#t", "http://b.net/de/4", None, "", "nothing", "ftp://x://y/z", "http://com/", "http://xcom/", "http://h.org", "http://q.net?/es/"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, url_key long").withColumn("verdict", F.lit("clash"))
    labels = spark.createDataFrame([], "url_key long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0] if best else None)
        assert got[i].verdict == (best[1] if best else "allow")


def test_templates_learn_bad_branches(spark):
    rows, key = [], 0
    for branch, bad in (("spam", 1), ("news", 0)):
        for i in range(40):
            rows.append((key, f"http://h.org/{branch}/item-{i}/x{i}", key, bad))
            key += 1
    frame = spark.createDataFrame(rows, "page_id long, url string, url_key long, bad int")
    got = url_filter.judge(frame.drop("bad"), frame.filter("page_id % 2 = 0").select("url_key", "bad")).collect()
    assert {(r.path.split("/")[1], r.verdict) for r in got} == {("spam", "block"), ("news", "allow")}
    assert {r.template for r in got} == {"/spam/*/*", "/news/*/*"}


def test_empty_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, url_key long")
    assert url_filter.judge(empty, spark.createDataFrame([], "url_key long, bad int")).count() == 0


# --- 2 -----------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "hi <|end|> there"), (1, 1, "assistant", "a <\\|turn|> b\\<|"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", " é 漢字 😀 "),
    (2, 0, "assistant", "<"), (2, 0, "assistant", "<"), (3, 0, None, "x"), (None, 0, "assistant", "n<|endoftext|>"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    for part_chars in (1 << 20, 5):
        parts = chat.format_conversations(rows, chat.ChatParams(queries.TOKENIZER, part_chars=part_chars))
        got = {r.conv_id: r for r in chat.digests(parts).collect()}
        by: dict = {}
        for c, t, r, x in sorted(CHAT, key=lambda r: (r[1], r[2] or "", r[3] or "")):
            by.setdefault(c, []).append((r or "", x or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            loss = "".join(x for r, x in turns if r == "assistant")
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c].formatted_chars == len(chat.render(turns)[0])


def test_long_conversation_is_spread(spark):
    turns = [(7, t, ("user", "assistant")[t % 2], f"turn {t} <|end|> of many") for t in range(600)]
    rows = spark.createDataFrame([*turns, (3, 0, "user", "a"), (9, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = chat.format_conversations(rows, chat.ChatParams(queries.TOKENIZER)).cache()
        assert parts.filter("conv_id = 7").count() > 1
        text = "".join(r.text for r in parts.filter("conv_id = 7").orderBy("part").collect())
        assert chat.parse(text) == [(r, x) for _, _, r, x in turns]
        got = {r.conv_id: r for r in chat.digests(parts.orderBy(F.desc("part"))).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert set(got) == {3, 7, 9}
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256("".join(x for _, _, r, x in turns if r == "assistant").encode()).hexdigest()


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(500):
        t = "".join(rng.choice(["<", "|", "\\", "turn", "|>", "a", "<|end|>"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t
        assert "<|" not in chat.escape(t)


def test_mask_by_binary_search():
    tokens = np.array([[0, 2], [2, 5], [5, 5], [5, 9], [9, 10]])
    spans = np.array([[2, 4], [9, 10]])
    want = [any(a < t1 and t0 < b for a, b in spans) for t0, t1 in tokens]
    assert chat.mask_tokens(tokens, spans).tolist() == want


# --- 3 -----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and a long text about them, really long, longer than the article itself, on and on and on.</div>
<div id="wrap"><div class="post-12"><h1>Head &amp; line</h1><p>One  <b>two</b>&nbsp;three<br>four<p>Next &eacute;<form>f</form></div><aside>Side</aside>
<div class="comments"><p>A reader comment that is rather long, a reader comment that is rather long</p></div></div><!-- c --><footer>F</footer></body></html>"""


def test_extracts_article(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", PAGE.replace("post-12", "post-13")), (3, "http://h/3", None), (4, None, ""), (5, "x", "plain text only"), (5, "x", "plain text only")]
    rows.append((6, "http://h/6", "<article>" + "<p>long text" * 20_000))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7
    assert by[1] == by[2] == "Head & line\nOne two three four\nNext é"
    assert by[3] == by[4] == ""
    assert by[6].count("\n") == 19_999


def test_extracts_given_pages(spark):
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op3_html_extract(spark, SMALL).collect()}
    import html

    for r in pages.itertuples():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(x for x in want if x)


# --- 4 -----------------------------------------------------------------------


def plain_targets(sizes: dict, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_mix(spark, docs, odd):
    frame = odd_docs(spark) if odd else spark.createDataFrame(docs)
    got = mixing.mix(frame, mixing.MixParams(range_rows=7)).toPandas()
    again = mixing.mix(frame.repartition(3), mixing.MixParams(range_rows=7)).toPandas()
    key = lambda f: sorted(map(str, f[["doc_id", "source", "size", "taken"]].itertuples(index=False)))
    assert key(got) == key(again)
    plain = frame.toPandas()
    assert len(got) == len(plain)
    assert got["size"].sum() == sum(len(WORD.findall(t or "")) for t in plain["text"])
    got["source"] = [None if not isinstance(s, str) else s for s in got["source"]]
    sizes = {s: int(g["size"].sum()) for s, g in got.groupby(got["source"].map(lambda s: (s,)), dropna=False)}
    sizes = {k[0]: v for k, v in sizes.items()}
    want = plain_targets(sizes)
    for s, g in got.groupby(got["source"].map(lambda s: (s,))):
        t = want[s[0]]
        assert g["target"].iloc[0] == pytest.approx(t)
        assert abs(g["taken"].sum() - t) <= 1
    assert (got["taken"] <= 2 * got["size"]).all()


def test_take_gives_taken_words(spark):
    frame = odd_docs(spark)
    plan = mixing.mix(frame)
    out = mixing.take(frame, plan).toPandas()
    words = out["text"].map(lambda t: len(WORD.findall(t or ""))).groupby(out["doc_id"].fillna(-1)).sum()
    taken = plan.toPandas().assign(k=lambda f: f["doc_id"].fillna(-1)).groupby("k")["taken"].sum()
    assert {k: v for k, v in taken.items() if v} == words.to_dict()


# --- 5 -----------------------------------------------------------------------


def check_packing(rows: pd.DataFrame, texts: list, length=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.TOKENIZER)
    tok.encode_special_tokens = True
    want = []
    for t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(want) == sorted(rows[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum()[:-1]]).all()
        assert g["length"].sum() <= length
    bound = -(-rows["length"].sum() // length)
    assert rows["sequence_id"].nunique() <= bound * 1.01 + 2


def test_packs_given_and_odd_documents(spark, docs):
    check_packing(queries.op5_pack(spark, SMALL).toPandas(), list(docs["text"]))
    odd = odd_docs(spark)
    check_packing(packing.pack_documents(odd, packing.PackParams(queries.TOKENIZER)).toPandas(), [r.text for r in odd.collect()])
    assert packing.pack_documents(odd.limit(0), packing.PackParams(queries.TOKENIZER)).count() == 0


def test_encoder_on_white_space():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.TOKENIZER)
    tok.encode_special_tokens = True
    enc = packing.Encoder(queries.TOKENIZER)
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice([" ", "\n", "\t", "\u3000", "\x85", "a", "it's", "12", "!?", "é", "<|endoftext|>", "'ll"]) for _ in range(rng.randrange(14)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    for t in (" " * 1_500_000 + "x", "\n \n" * 400_000, "a" * 200_000):  # more in a row than the faster library bears
        assert enc.ids(t) == tok.encode(t, add_special_tokens=False).ids


def test_chat_encoder_gives_the_offsets_of_the_named_library():
    enc = chat.OffsetEncoder(queries.TOKENIZER)
    assert enc.fast is not None
    rng = random.Random(2)
    texts = ["".join(rng.choice([" ", "\n", "\u3000", "a", "it's", "12", "!?", "é", "日本", "🙂", "👩‍👩‍👧", "e\u0301", chat.TURN, chat.TEXT, chat.END, "<|endoftext|>", "<\\|end|>"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    for t in [*texts, "x" + " " * 1_200_000 + "é"]:
        want = enc.tok.encode(t, add_special_tokens=False)
        ids, spans = enc(t)
        assert ids.tolist() == want.ids
        assert [tuple(x) for x in spans.tolist()] == want.offsets


def test_local_search_empties_bins():
    for lengths, bins, want in (
        ([7, 6, 3, 4], [[0], [1, 2], [3]], 2),  # one for one
        ([6, 6, 4, 4], [[0], [1], [2, 3]], 2),  # moves
        ([5, 3, 3, 2, 2, 5], [[0, 1], [2, 3, 4], [5]], 2),  # two for one or one for two
    ):
        out = packing.improve(bins, np.array(lengths), 10)
        assert len(out) == want
        assert sorted(i for b in out for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 10 for b in out)


# --- 6 and 7 -------------------------------------------------------------------


def test_edited_fingerprints(spark, docs):
    for frame in (docs, odd_docs(spark).filter("doc_id is null or doc_id <> 4").toPandas(), docs.head(1)):
        frame = frame.assign(text=frame["text"].fillna("").astype(str))
        order = frame.sort_values("doc_id", na_position="first").reset_index(drop=True)
        got = simhash.edited_fingerprints(spark.createDataFrame([(None if pd.isna(k) else int(k), t) for k, t in zip(frame["doc_id"], frame["text"])], "doc_id long, text string")).toPandas()
        assert len(got) == len(order)
        of = simhash.TermFingerprint()
        got = {None if pd.isna(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
        for i, r in order.iterrows():
            nxt = order["text"][(i + 1) % len(order)]
            half = len(r.text) // 2
            edited = r.text[: len(r.text) - half] + nxt[:half]
            g = got[None if pd.isna(r.doc_id) else int(r.doc_id)]
            assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
            assert (g.fingerprint, g.edited_fingerprint) == (of(r.text).hex(), of(edited).hex())
            assert g.near_next == simhash.likeness(of(r.text), of(nxt))


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(pairs):
    ids = list(range(len(pairs)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(ids, 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    groups: dict = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: min((pairs[m][0] for m in g if pairs[m][0] is not None), default=None) for g in groups.values() for i in g}


def test_simhash_dedup(spark, docs):
    base = list(docs[["doc_id", "text"]].itertuples(index=False, name=None))[:80]
    long = max(base, key=lambda r: len(r[1]))[1]
    rows = base + [(1000 + i, long.replace(" ", "  ", i) + " extra" * (i % 3)) for i in range(12)] + [(None, long), (2000, None), (2001, " "), (2000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(frame).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    pairs = [(k, plain_fingerprint(t)) for k, t in rows]
    want = plain_components(pairs)
    assert sorted(map(str, [(k, f"{f:016x}", want[i]) for i, (k, f) in enumerate(pairs)])) == sorted(map(str, map(tuple, got)))
    kept = simhash.representatives(frame.withColumn("__place2", F.lit(1))).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(k) for k in want.values()})


def test_pairs_and_search_find_all(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centre for _ in range(40)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    dist = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if dist(a, b) <= 3}
    for blocks in (4, 6, 7):
        got = [tuple(r) for r in simhash.near_pairs(frame, simhash.TableParams(blocks=blocks)).collect()]
        assert len(got) == len(set(got)) and {tuple(sorted(x)) for x in got} == want
    found = {(r.query, r.found) for r in simhash.search(frame.limit(30), frame).collect()}
    asked = {r.fp for r in frame.limit(30).collect()}
    assert found == {(a, b) for a in asked for b in fps if dist(a, b) <= 3}


# --- 8 -----------------------------------------------------------------------


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype("float32")
    x[:900] = x[0]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [1.0] * 3), (5080, [None] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = ann.search(frame, F.col("vec_id") % 20 == 0, ann.AnnParams(sample=1500, part_rows=400, block_rows=100, query_rows=40)).toPandas()
    d, hit, total = x.astype("float64"), 0, 0
    for q in range(0, 3000, 20):
        s = (d * d[q]).cumsum(1)[:, -1]  # from the first component to the last, as SQL sums
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        assert list(g["score"]) == [s[i] for i in g["vec_id"]]
        assert list(g["score"]) == sorted(g["score"], reverse=True)
        hit += len(set(g["vec_id"]) & set(order))
        total += 20
    assert set(got["query_id"]) == set(range(0, 3000, 20))
    assert hit / total >= 0.9
    few = ann.search(frame.filter("vec_id in (0, 1, 5000)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


# --- 9 -----------------------------------------------------------------------


def test_quality_held_out(spark):
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    lab = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    params = quality.QualityParams()
    train = lab[lab.doc_id % 2 == 0].assign(grade=lambda f: f.quality + 1 - f.toxic)[["doc_id", "grade"]]
    test = lab[lab.doc_id % 2 == 1].merge(d, on="doc_id")
    model = quality.train(spark.createDataFrame(d[["doc_id", "text"]]), spark.createDataFrame(train))
    of = quality.Features(params.bits)
    tail = model.tail(model.latent([of(t) for t in test["text"]]))
    assert (np.diff(tail, axis=1) <= 0).all()
    keep = tail[:, 1] >= params.keep_at
    clean = (test.quality == 1) & (test.toxic == 0)
    insults = test["text"].str.contains("idiot|moron|worthless|pathetic|stupid|scum|trash")
    assert keep[clean].mean() > 0.98
    assert keep[test.quality == 0].mean() < 0.06
    assert keep[insults].mean() < 0.2


def test_quality_odd_rows(spark):
    frame = odd_docs(spark).withColumn("keep", F.lit("clash"))
    labels = spark.createDataFrame([(1, 2), (4, 0), (None, 1), (6, None)], "doc_id long, grade int")
    out = quality.score(frame, quality.train(frame, labels)).collect()
    assert len(out) == 8 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    nothing = quality.train(frame, labels.limit(0))
    assert all(r.keep for r in quality.score(frame, nothing).collect())
    assert quality.score(frame.limit(0), nothing).count() == 0


# --- 10 -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, big2 = "<p>é" * 400, "x" * 1000
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3 \n", "s"), (4, "u", "s"), (5, "u", None), (6, "u", big), (7, "u", big2), (7, "u", big2), (None, "u", big2), (8, "u", "y" * 3_000_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = new_path(spark, "warc-test")
    params = warc.WarcParams()
    files = warc.write_archives(warc.plan_records(frame, params), folder, warc.train_dictionary(frame, params), params)
    got = warc.read_archives(files).toPandas()
    assert len(got) == len(rows) == files.agg(F.sum("records")).first()[0]
    keep = {big: 6, big2: 7}
    for k, _, h in rows:
        g = got[got["page_id"].isna() if k is None else got["page_id"] == k]
        data = (h or "").encode()
        to = keep.get(h)
        revisit = to is not None and k != to
        for r in g.itertuples():
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert r.record_type == ("revisit" if revisit else "response")
            assert (pd.isna(r.refers_to) and not revisit) or r.refers_to == to
            assert bytes(r.payload) == (b"" if revisit else data)
    assert warc.archive_pages(spark, frame.limit(0)).count() == 0


def test_reader_checks_frames():
    import io

    import zstandard

    word = zstandard.train_dictionary(1024, [f"WARC-Type: response {i} Content-Length".encode() * 4 for i in range(200)]).as_bytes()
    raw = warc.record_bytes("response", 1, "http://a", b"body", hashlib.sha1(b"body").hexdigest(), None)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(word)).compress(raw)
    packed = zstandard.ZstdCompressor().compress(word)
    for lead in (word, packed):
        data = warc.dictionary_frame(lead) + frame + b"\x50\x2a\x4d\x18\x02\x00\x00\x00ab" + frame
        assert [b for _, b in warc.read_frames(io.BytesIO(data))] == [b"body", b"body"]
    plain = zstandard.ZstdCompressor()
    bad = [
        warc.dictionary_frame(word) + frame[:-3], b"PK\x03\x04xxxx", frame + warc.dictionary_frame(word), warc.dictionary_frame(word)[:-1],
        plain.compress(raw + raw), plain.compress(raw.replace(b"Content-Length: 4", b"Content-Length: 5")), plain.compress(raw.replace(b"WARC-Date", b"X-Date")), plain.compress(raw.replace(b"WARC/1.1", b"HTTP/1.1")),
    ]
    for data in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(data)))
