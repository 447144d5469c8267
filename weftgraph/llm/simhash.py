"""SimHash fingerprints: computing them, searching them, and near-dedup by them."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import frame, map_frames
from weftgraph.plans.stage import materialize

# --- kernels ----------------------------------------------------------------


def shingle_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits by majority over the hashes of word shingles, repeats included.

    A-Z are lower-cased and words end at ASCII white space, which is what the
    bytes methods do. No words: 0.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = list(map(b" ".join, zip(*[w[i:] for i in range(words)]))) or [b" ".join(w)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, seed) for g in grams]), dtype=np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(grams)).tobytes(), "big")


class TermFingerprint:
    """Weighted SimHash of a text's words and word pairs, ``64 * lanes`` bits.

    A term of frequency f votes with 1 + ln f, a pair with twice that. Word
    hashes are kept between texts; pair hashes are mixed from them.
    """

    CACHE = 300_000

    def __init__(self, lanes: int = 2, seed: int = 7) -> None:
        self.lanes, self.seed, self.cache = lanes, seed, {}
        # odd multipliers, drawn once from the seed
        self.mult = (np.random.default_rng(seed).integers(1, 2**63, size=(2, lanes), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        try:
            raw = b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > self.CACHE:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = b"".join(xxhash.xxh64_digest(w, self.seed + i) for i in range(self.lanes))
            raw = b"".join([cache[w] for w in words])
        return np.frombuffer(raw, dtype=np.uint64).reshape(-1, self.lanes)

    def __call__(self, text: str) -> bytes:
        words = text.encode().lower().split()
        if not words:
            return bytes(8 * self.lanes)
        h = self.hashes(words)
        votes = self.votes(h, 1.0)
        if len(words) > 1:
            pair = h[:-1] * self.mult[0] ^ (h[1:] >> np.uint64(31)) ^ (h[1:] * self.mult[1])
            pair = (pair ^ (pair >> np.uint64(29))) * self.mult[1]
            pair ^= pair >> np.uint64(32)
            votes = votes + self.votes(pair, 2.0)
        return np.packbits(votes > 0).tobytes()

    @staticmethod
    def votes(h: np.ndarray, scale: float) -> np.ndarray:
        _, at, n = np.unique(h[:, 0], return_index=True, return_counts=True)
        weight = ((1.0 + np.log(n)) * scale).astype(np.float32)
        bits = np.unpackbits(np.ascontiguousarray(h[at]).view(np.uint8).reshape(len(at), -1), axis=1)
        return 2.0 * (weight @ bits) - weight.sum()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the differing bits estimate, 0 for unrelated, 1 for equal fingerprints."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / (8 * len(a))))) if differ else 1.0


# --- fingerprints of documents and of their edited texts ---------------------


@dataclass(frozen=True)
class EditParams:
    """Rows are dealt into ranges of the id of about ``range_rows`` rows."""

    lanes: int = 2
    seed: int = 7
    range_rows: int = 2_000
    max_ranges: int = 4096


EDITED = "doc_id long, n_chars long, edited_sha256 binary, prints array<long>, edited_prints array<long>, near_edited double, near_next double"
#: ``edge`` 1: the first text of a range; 2: the last document of a range, without its successor; 0: any other document.
RANGED = f"range int, edge int, text string, {EDITED}"


def lanes_of(fingerprint: bytes) -> list[int]:
    return np.frombuffer(fingerprint, dtype=">i8").tolist()


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, params: EditParams = EditParams(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: its fingerprint, and that of its text with the second half overwritten by the next document's beginning.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, prints)``; ``prints`` are the fingerprint's lanes.

    Documents are in ascending order of ids, null ids first, equal ids by the
    hash of the text; the first follows the last, and a single document is its
    own next. Null texts are empty, and empty texts have the fingerprint zero.
    Repeated rows stay. An empty table gives an empty one; columns other than
    the two take no part.

    One shuffle of the texts, into ranges of (id, hash of the text, random):
    there are as many ranges as the session has shuffle partitions, and rows
    equal in id and text, which may follow each other in any order, are spread
    over them. A range does not see the next one, so it is written with its
    first text and its last document, and these few rows are joined. Short
    ranges share a task and a file, so many partitions of a small table do
    not make many files. What is returned only reads written tables.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"__h": F.xxhash64("text"), "__r": F.rand(params.seed)})
    ranged = rows.repartitionByRange("doc_id", "__h", "__r").sortWithinPartitions("doc_id", "__h")
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("range"))  # not the task's number, as a task may have several ranges
    ranged_names, names = ([x.split()[0] for x in t.split(", ")] for t in (RANGED, EDITED))

    def report(of: TermFingerprint, k: int | None, t: str, p: bytes, following: str, following_print: bytes) -> tuple:
        e = edited(t, following)
        q = of(e)
        return (k, len(t), hashlib.sha256(e.encode()).digest(), lanes_of(p), lanes_of(q), likeness(p, q), likeness(p, following_print))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, at, last = TermFingerprint(params.lanes, params.seed), None, None
        for pdf in batches:
            out: list[tuple] = []
            for k, t, at in zip(pdf["doc_id"], pdf["text"], pdf["range"]):
                p = of(t)
                out.append((at, 1, t, *[None] * 7) if last is None else (at, 0, None, *report(of, *last, t, p)))
                last = (None if pd.isna(k) else int(k), t, p)
            if out:
                yield frame(out, ranged_names)
        if last is not None:
            yield frame([(at, 2, last[1], last[0], *[None] * 6)], ranged_names)

    got = materialize(few_files(map_frames(ranged, run, RANGED), docs.count(), TEXTS_A_FILE), "edited")
    # one row a range
    heads = got.filter("edge = 1").select(F.col("range").alias("next"), F.col("text").alias("following"))
    order = Window.orderBy("range")
    after = got.filter("edge = 1").select("range").select("range", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("next"))
    ends = got.filter("edge = 2").select("range", "doc_id", "text").join(after, "range").join(heads, "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = TermFingerprint(params.lanes, params.seed)
        for pdf in batches:
            out = [report(of, None if pd.isna(k) else int(k), t, of(t), f, of(f)) for k, t, f in zip(pdf["doc_id"], pdf["text"], pdf["following"])]
            yield frame(out, names)

    closed = materialize(few_files(map_frames(ends, close, EDITED), got.filter("edge = 2").count(), TEXTS_A_FILE), "closed")
    every = got.filter("edge = 0").select(*names).unionByName(closed)
    sha = F.lower(F.hex("edited_sha256")).alias("edited_sha256")
    strings = [F.concat(*[hexadecimal(F.col(c)[i]) for i in range(params.lanes)]).alias(n) for c, n in (("prints", "fingerprint"), ("edited_prints", "edited_fingerprint"))]
    return every.select("doc_id", "n_chars", sha, *strings, "near_edited", "near_next", "prints")


def with_near(rows: DataFrame, is_query: Column, params: "TableParams", prints: str = "prints") -> DataFrame:
    """Add ``n_near`` to ``rows``: how many other distinct fingerprints of all rows lie within the radius of a query row's.

    Rows that are no queries have a null. ``prints`` are arrays of 64-bit
    lanes. ``rows`` are read several times, so they should be written ones.
    """
    asks = F.coalesce(is_query, F.lit(False))
    near = search(rows.filter(asks), rows, params, prints).groupBy("query").agg((F.count(F.lit(1)) - 1).alias("n_near"))  # all find themselves
    found = few_files(rows.filter(asks).join(near, F.col(prints) == F.col("query")).drop("query"), rows.filter(asks).count())
    return found.unionByName(rows.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))


# --- search within a Hamming radius -------------------------------------------


@dataclass(frozen=True)
class TableParams:
    """``blocks`` of the ``bits``; ``radius`` of them at most differ in a pair, so it shares ``blocks - radius`` and meets in one of the permuted tables.

    Fingerprints are longs, or of more than 64 bits arrays of longs.
    """

    radius: int = 3
    bits: int = 64
    blocks: int = 6

    def masks(self) -> list[list[int]]:
        """What each table keeps, one signed mask a lane; bits are counted from the low end of the last lane."""
        out, lanes = [], -(-self.bits // 64)
        widths = block_widths(self.bits, self.blocks)
        for kept in itertools.combinations(range(self.blocks), self.blocks - self.radius):
            whole = sum(((1 << w) - 1) << at for at, w in (widths[i] for i in kept))
            words = [whole >> 64 * i & (1 << 64) - 1 for i in reversed(range(lanes))]
            out.append([x - (1 << 64) if x >> 63 else x for x in words])
        return out

    def lanes(self, fp: Column) -> list[Column]:
        return [fp] if self.bits <= 64 else [fp[i] for i in range(-(-self.bits // 64))]

    def distance(self, a: Column, b: Column) -> Column:
        return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(self.lanes(a), self.lanes(b))), F.lit(0))


def block_widths(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(first bit from the low end, width) of each block."""
    out, at = [], 0
    for i in range(blocks):
        width = bits // blocks + (1 if i < bits % blocks else 0)
        out.append((at, width))
        at += width
    return out


def table_keys(fp: Column, params: TableParams) -> Column:
    """Array of the keys of a fingerprint, one a table: the table's number and the bits it keeps (of several lanes, their hash)."""

    def kept(masks: list[int]) -> Column:
        words = [x.bitwiseAND(F.lit(m).cast("long")) for x, m in zip(params.lanes(fp), masks)]
        return words[0] if len(words) == 1 else F.xxhash64(*words)

    return F.array(*[F.struct(F.lit(i).cast("short").alias("t"), kept(m).alias("bits")) for i, m in enumerate(params.masks())])


def first_met(a: Column, b: Column, params: TableParams) -> Column:
    """The first table in which two fingerprints meet."""
    return F.array_position(F.zip_with(table_keys(a, params), table_keys(b, params), lambda x, y: x["bits"] == y["bits"]), True) - 1


def near_pairs(prints: DataFrame, params: TableParams = TableParams(), fp: str = "fp") -> DataFrame:
    """``(a, b)``, a < b: all pairs of *distinct* fingerprints within the radius.

    ``prints`` must be distinct. Candidates share the kept bits of a table;
    only the first table in which a pair meets reports it, so no distinct is
    needed after the check of the distance.
    """
    keyed = prints.select(F.col(fp).alias("fp"), F.explode(table_keys(F.col(fp), params)).alias("k")).select("fp", "k.t", "k.bits")
    left = keyed.select(F.col("fp").alias("a"), "t", "bits")
    right = keyed.select(F.col("fp").alias("b"), "t", "bits")
    near = params.distance(F.col("a"), F.col("b")) <= params.radius
    met = left.join(right, on=(left["t"] == right["t"]) & (left["bits"] == right["bits"]) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "b", left["t"].alias("t")).filter(first_met(F.col("a"), F.col("b"), params) == F.col("t")).select("a", "b")


def search(queries: DataFrame, prints: DataFrame, params: TableParams = TableParams(), fp: str = "fp") -> DataFrame:
    """``(query, found, distance)``: for each distinct query fingerprint all distinct fingerprints within the radius, itself included."""
    keyed = lambda df, name: df.select(F.col(fp).alias(name)).distinct().withColumn("k", F.explode(table_keys(F.col(name), params))).select(name, "k.t", "k.bits")
    q, p = keyed(queries, "query"), keyed(prints, "found")
    distance = params.distance(F.col("query"), F.col("found"))
    met = q.join(p, on=(q["t"] == p["t"]) & (q["bits"] == p["bits"]) & (distance <= params.radius))
    met = met.select("query", "found", distance.alias("distance"), q["t"].alias("t"))
    return met.filter(first_met(F.col("query"), F.col("found"), params) == F.col("t")).select("query", "found", "distance")


# --- components -----------------------------------------------------------------

#: Narrow rows that are worth a file of their own; texts that are.
ROWS_A_FILE = 8192
TEXTS_A_FILE = 1000


def few_files(df: DataFrame, rows: int, each: int = ROWS_A_FILE) -> DataFrame:
    """``df`` of at most ``rows`` rows in no more parts than these fill, ``each`` to one; never in more than it has."""
    return df.coalesce(max(1, -(-rows // each)))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b): the smallest node of its component.

    Alternating star contraction: large neighbours, then small ones, move to
    the smallest known neighbour until nothing changes. Each round is written
    to the shared folder; nodes without links do not appear.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    rows, state = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(few_files(small.filter("u <> v").distinct(), rows), "links")  # a round never adds links
        # equal counts and equal hash sums: nothing moved
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (row["n"], row["h"]):
            break
        state = (row["n"], row["h"])
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


FINGERPRINTS = "doc_id long, text_key long, fp long"


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` of whole texts; null and wordless texts have 0. ``text_key`` is ``xxhash64`` of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([shingle_fingerprint(t) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "fp": fps})

    return map_frames(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")), run, FINGERPRINTS)


def near_duplicates(docs: DataFrame, params: TableParams = TableParams(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row a row of ``docs``; the smallest id among all linked texts.

    Null, empty and wordless texts have the fingerprint zero and are linked
    like any other; repeated rows stay; an empty table gives an empty one.
    Columns other than the two take no part, whatever their names.
    """
    return marked(docs, params, id, text).select("doc_id", "fp", "component_id")


def marked(docs: DataFrame, params: TableParams = TableParams(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp, root, component_id)``; ``root`` is the component's own fingerprint.

    Equal fingerprints are one node however many documents have it, so copies
    cost no pairs; distinct ones meet in the permuted tables. Null ids take
    part and get their component's smallest id, null if none has one; repeated
    rows stay.
    """
    prints = materialize(fingerprints(docs, id, text), "fingerprints")
    nodes = materialize(few_files(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), prints.count()), "nodes")
    found = components(near_pairs(nodes, params))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(few_files(rooted, nodes.count()), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def representatives(docs: DataFrame, params: TableParams = TableParams(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, that with the smallest id.

    Of several rows of that id, or of none if all ids are null, the first by
    text stays. An id or null that is in several components stays in each; of
    rows equal in id and text any one. An empty table stays empty. Columns are
    kept as they are, whatever their names.

    Which (id, hash of the text) stays is decided on narrow rows. The texts
    are shuffled once: repeated rows are merged before, so a group of them
    does not meet in one task, and the join that follows is by the same key.
    """
    # one non-null key for null ids
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    marks = marked(docs, params, id, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialize(marks.select(key(F.col("doc_id")).alias("__k"), F.col("text_key").alias("__t"), F.col("root").alias("__root")).distinct(), "kept")
    several = kept.groupBy("__root").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__root")
    unsure = materialize(kept.join(several, "__root"), "unsure")
    rows = docs.withColumns({"__k": key(F.col(id)), "__t": F.xxhash64(text)})
    if not unsure.isEmpty():  # texts of one id in one component: these are compared themselves
        first = rows.select("__k", "__t", F.col(text).alias("__text")).join(unsure, ["__k", "__t"]).groupBy("__root").agg(F.min_by("__t", F.struct(F.col("__text").isNotNull(), "__text")).alias("__t"))
        kept = kept.join(several, "__root", "left_anti").unionByName(unsure.join(first, ["__root", "__t"]))
    return rows.dropDuplicates(["__k", "__t"]).join(kept.select("__k", "__t"), ["__k", "__t"], "left_semi").select(*docs.columns)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
