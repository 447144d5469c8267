"""Ordinal quality classifier: cumulative-link regression on graded ratings.

One weight vector over hashed text features, shared by all grades, and ordered
thresholds: P(grade > g) = sigmoid(w.x - theta_g). It gives an expected grade
and the probability of a grade that is good enough.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = string.punctuation


@dataclass(frozen=True)
class QualityParams:
    """Fitted on at most ``sample`` labelled rows, the ones of smallest hash; features seen in fewer than ``min_rows`` of them weigh nothing.

    A document is kept if P(grade >= ``good``) reaches ``keep_at``.
    """

    sample: int = 8000
    bits: int = 18
    min_rows: int = 5
    l2: float = 2.0
    steps: int = 250
    good: int = 2
    grades: int = 3
    keep_at: float = 0.7
    seed: int = 3


def grade(quality: Column, toxic: Column) -> Column:
    """0, 1 or 2: one for good prose and one for not toxic; null if a rating is."""
    return (quality + (1 - toxic)).cast("int")


class Features:
    """Distinct hashed features of a text: words, shapes of words by how often, and repetition."""

    CACHE = 300_000

    def __init__(self, bits: int) -> None:
        self.mask, self.cache = (1 << bits) - 1, {}

    def bucket(self, name: str) -> int:
        return xxhash.xxh64_intdigest(name, 11) & self.mask

    def word(self, w: str) -> tuple[int, str]:
        """(bucket of the word without outer punctuation, its shape): case, digits, and the marks around it."""
        core = w.strip(MARKS)
        tail = w[len(w.rstrip(MARKS)) :][:3]
        case = "A" if len(core) > 1 and core.isupper() else "a" if core.isalpha() else "0" if core else ""
        return self.bucket("w:" + core.lower()), case + tail

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.array([self.bucket("empty")], dtype=np.int32)
        counts = Counter(words)
        cache, found, shapes = self.cache, set(), {}
        if len(cache) > self.CACHE:
            cache.clear()
        for w, c in counts.items():
            got = cache.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= 64:  # so that the cache stays small
                    cache[w] = got
            found.add(got[0])
            shapes[got[1]] = shapes.get(got[1], 0) + c
        for s, c in shapes.items():
            for level in range(1, 6):  # share of the words of this shape: at least 1/2, 1/4, ...
                if c * (1 << level) >= n:
                    found.add(self.bucket(f"s:{s}:{level}"))
        again = sum(map(eq, words, words[1:]))
        found.add(self.bucket(f"rep:{int(10 * again / n)}"))
        found.add(self.bucket(f"uniq:{int(10 * len(counts) / n)}:{min(n.bit_length(), 12)}"))
        found.add(self.bucket(f"len:{min(n.bit_length(), 16)}"))
        return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tail(self, f: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade > g)."""
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds[None, :], -40, 40)))

    def latent(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows], dtype=np.float64)


def fit(rows: list[np.ndarray], grades: np.ndarray, params: QualityParams) -> Ordinal:
    """Maximum a posteriori by Adam on all rows at once; thresholds stay ordered by their gaps being exponentials."""
    width = 1 << params.bits
    thresholds0 = np.linspace(-1.0, 1.0, params.grades - 1)
    if not rows:
        return Ordinal(np.zeros(width), thresholds0 - 4.0, params.bits)  # nothing known: all are kept
    flat = np.concatenate(rows)
    seen = np.bincount(flat, minlength=width) >= min(params.min_rows, max(1, len(rows) // 4))
    col_of = np.cumsum(seen) - 1
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ok = seen[flat]
    cols, owner = col_of[flat[ok]], owner[ok]
    n, d, cuts = len(rows), int(seen.sum()), params.grades - 1
    # features by the log odds they show on their own, so that the many without evidence stay quiet
    good = grades >= params.good
    in_good, in_bad = (np.bincount(cols[good[owner] == g], minlength=d) for g in (True, False))
    odds = np.log((in_good + 0.5) / (good.sum() + 1)) - np.log((in_bad + 0.5) / ((~good).sum() + 1))
    noise = np.sqrt(1 / (in_good + 0.5) + 1 / (in_bad + 0.5))
    scale = np.maximum(np.abs(odds) - noise, 0.0)
    w, base, gaps = np.zeros(d), thresholds0[0], np.zeros(cuts - 1)
    state = [np.zeros(d + cuts), np.zeros(d + cuts)]
    for t in range(1, params.steps + 1):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        f = np.bincount(owner, weights=(w * scale)[cols], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(f[:, None] - theta[None, :], -40, 40)))
        # P(y) = s_{y-1} - s_y with s_{-1} = 1 and s_{K-1} = 0; the derivative of ln P(y) in f is 1 - s_{y-1} - s_y
        lo = np.where(grades > 0, s[np.arange(n), np.maximum(grades - 1, 0)], 1.0)
        hi = np.where(grades < cuts, s[np.arange(n), np.minimum(grades, cuts - 1)], 0.0)
        p = np.maximum(lo - hi, 1e-12)
        df = (lo * (1 - lo) - hi * (1 - hi)) / p
        dtheta = np.zeros(cuts)
        np.add.at(dtheta, np.minimum(grades, cuts - 1)[grades < cuts], (hi * (1 - hi) / p)[grades < cuts])
        np.add.at(dtheta, (grades - 1)[grades > 0], -(lo * (1 - lo) / p)[grades > 0])
        gw = np.bincount(cols, weights=df[owner], minlength=d) * scale - params.l2 * w
        ggap = np.array([dtheta[i + 1 :].sum() * np.exp(gaps[i]) for i in range(cuts - 1)])
        g = np.concatenate([gw, [dtheta.sum()], ggap]) / n
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, base, gaps = w + step[:d], base + step[d], np.clip(gaps + step[d + 1 :], -6, 4)
    weights = np.zeros(width)
    weights[seen] = w * scale
    return Ordinal(weights, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), params.bits)


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id: str = "doc_id", text: str = "text") -> Ordinal:
    """Fit on ``labels`` (doc_id, grade); null grades and ids do not count.

    The chosen labels, at most ``sample``, are broadcast, so the documents are
    scanned and not shuffled. Of several documents with a chosen id the one of
    smallest text hash counts, merged before anything is shuffled, so at most
    ``sample`` rows of features, hashed on the executors, reach the driver.
    """
    order = F.xxhash64(F.lit(params.seed), "doc_id", "grade")
    known = labels.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select(F.col("doc_id").alias("__id"), F.col("grade").cast("int").alias("__grade"), order.alias("__h")).distinct()
    chosen = chosen.orderBy("__h", "__id", "__grade").limit(params.sample)
    picked = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    picked = picked.groupBy("__id", "__grade", "__h").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features(params.bits)
        for pdf in batches:
            yield pd.DataFrame({"grade": pdf["__grade"], "h": pdf["__h"], "id": pdf["__id"].astype("int64"), "x": [np.sort(of(t)) for t in pdf["__text"]]})

    got = picked.mapInPandas(run, "grade int, h long, id long, x array<int>").toPandas()
    got["n"] = [len(x) for x in got["x"]]
    got = got.sort_values(["h", "id", "grade", "n"], kind="stable")  # so that reruns sum in the same order
    rows = [np.asarray(x, dtype=np.int64) for x in got["x"]]
    return fit(rows, got["grade"].to_numpy("int64"), params)


def score(docs: DataFrame, model: Ordinal, params: QualityParams = QualityParams(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``expected_grade``, ``tail_probability`` and ``keep``.

    A null text is empty; empty texts have a feature of their own. Whole texts
    are read, of any length. Repeated rows stay; an empty table gives an empty
    one. Columns with the added names are replaced. The model (8 bytes times
    2**bits) goes out with the tasks.
    """
    added = ("expected_grade", "tail_probability", "keep")
    rest = [c for c in docs.columns if c not in added]
    schema = docs.select(*rest).schema.add("expected_grade", "double").add("tail_probability", "double").add("keep", "boolean")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        of = Features(m.bits)
        for batch in batches:
            tail = m.tail(m.latent([of(t) for t in batch.column(text).to_pylist()]))
            p = tail[:, params.good - 1]
            made = [pa.array(x) for x in (tail.sum(axis=1), p, p >= params.keep_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*rest, *added])

    return docs.select(*rest).mapInArrow(run, schema)


def kept(docs: DataFrame, model: Ordinal, params: QualityParams = QualityParams(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` would mark with ``keep``, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        of = Features(m.bits)
        for batch in batches:
            p = m.tail(m.latent([of(t) for t in batch.column(text).to_pylist()]))[:, params.good - 1]
            yield batch.filter(pa.array(p >= params.keep_at))

    return docs.mapInArrow(run, docs.schema)
