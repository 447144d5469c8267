"""Mixing sources to target weights, with DataFrame operations only.

Rows get hash-random keys; per source they are dealt into key ranges, sorted
within a range, and running sums of their sizes are distributed prefix sums.
Each source is cut at its exact budget; whole epochs repeat where the budget
exceeds the source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.prefix import running_total
from weftgraph.llm.common import WORD, word_count
from weftgraph.plans.stage import materialize


@dataclass(frozen=True)
class MixParams:
    """Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times all sizes, none more than ``epochs`` times its own."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    epochs: int = 2
    seed: int = 17
    range_rows: int = 8192


def targets(sources: DataFrame, params: MixParams) -> DataFrame:
    """``(source, rows, source_size, target)`` from ``(source, rows, source_size)``, one row a source.

    Filling by weight with caps in closed form: in order of cap / weight the
    first source that its share does not overfill fixes the common level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(params.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in params.weights]), (place + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * params.epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(whole) * F.lit(params.share),
        "filled": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("filled")) / F.col("left"))
    s = s.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("common")))
    return s.select("source", "rows", "source_size", target.alias("target"))


def mix_key(seed: int, id: Column, text: Column) -> Column:
    """60 bits of the MD5 of seed, id and text (nulls left out): a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), id.cast("string"), text)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, params: MixParams = MixParams(), id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, key)``, one row a row of ``docs``.

    ``taken`` words: as many whole epochs as the budget floor(target) holds,
    and of the rest what the documents before in key order leave, so the last
    one taken may be cut. Null ids and sources are values of their own;
    repeated rows are taken row by row; a size is words unless ``size`` is
    given. The key depends on the id, the text and the seed alone, so reruns
    agree. Only these narrow columns are shuffled. An empty table gives an
    empty one; columns other than the three take no part. Sources are planned
    in one task, one row each, so they are meant to be few.
    """
    words = word_count(F.col(text)) if size is None else size
    key = mix_key(params.seed, F.col(id), F.col(text))
    narrow = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), key.alias("key"))
    narrow = materialize(narrow, "mix-sizes")
    per = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    planned = materialize(targets(per, params), "mix-targets")
    left, right = narrow.alias("l"), planned.alias("r")
    rows = left.join(right, F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.rows", "r.source_size", "r.target")
    # key ranges of about range_rows rows each: hot sources get more of them
    parts = F.greatest(F.ceil(F.col("rows") / params.range_rows), F.lit(1))
    unit = F.col("key").cast("double") / F.lit(float(1 << 60))
    bucket = F.least(F.floor(unit * parts).cast("long"), parts - 1)
    run = running_total(rows, bucket, [F.col("key"), F.col("doc_id"), F.col("size")], F.col("size"), "upto", by=("source",))
    budget = F.floor("target").cast("long")
    own = F.greatest(F.col("source_size"), F.lit(1))
    full = F.floor(budget / own).cast("long")
    full = F.when(full * own > budget, full - 1).otherwise(full)
    rest = budget - full * own
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    taken = F.when(F.col("source_size") > 0, full * F.col("size") + part).otherwise(0)
    return run.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key")


def take(docs: DataFrame, plan: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = MixParams.seed) -> DataFrame:
    """The mixed rows themselves: each document once an epoch, a cut one with its first words, joined by one space.

    Rows equal in id, source and text share what the plan takes of them: each
    gets the whole epochs, the rest goes to the first ones. They are numbered
    by one task a group; documents without words are in no mix and are left
    out before. The texts are shuffled once, and joined by the key that they
    are numbered by. An empty table gives an empty one; columns are kept as
    they are, but ``n_chars`` follows a cut text.
    """
    same = lambda i, s, k: F.struct(i.alias("i"), s.alias("s"), k.alias("k"))  # noqa: E731  (nulls equal in a struct)
    d = docs.filter(word_count(F.col(text)) > 0).withColumn("__k", same(F.col(id).cast("string"), F.col(source).cast("string"), mix_key(seed, F.col(id), F.col(text))))
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(F.lit(0))))
    p = plan.groupBy(same(F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("key")).alias("__k"))
    p = p.agg(F.count(F.lit(1)).alias("__m"), F.sum("taken").alias("__sum"), F.max("size").alias("__size")).filter("__sum > 0")
    both = d.join(p, "__k")
    epochs = F.floor(F.col("__sum") / (F.col("__m") * F.col("__size")))
    rest = F.col("__sum") - epochs * F.col("__m") * F.col("__size") - (F.col("__n") - 1) * F.col("__size")
    taken = epochs * F.col("__size") + F.greatest(F.lit(0), F.least(rest, F.col("__size")))
    both = both.withColumn("__taken", taken).filter("__taken > 0")
    full, over = F.floor(F.col("__taken") / F.col("__size")).cast("int"), (F.col("__taken") % F.col("__size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), full), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<int>")))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    out = both.withColumn("__cut", F.explode(copies))
    cut = F.when(F.col("__cut") > 0, F.array_join(F.slice(words, 1, F.greatest("__cut", F.lit(1))), " ")).otherwise(F.col(text))
    out = out.withColumn(text, cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sql(params: MixParams = MixParams()) -> str:
    """The plan of ``mix`` over ``documents`` as plain SQL."""
    weights = ", ".join(f"{w}.0::DOUBLE" for w in params.weights)
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws('|', '{params.seed}', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [{weights}][1 + place % {len(params.weights)}] AS weight, source_size * {params.epochs} AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM s) * {params.share} AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST {rows}), 0.0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS common),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, weight * common) END AS target FROM l, c),
b AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size {rows}), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(budget // greatest(source_size, 1) * size + greatest(0, least(size, budget % greatest(source_size, 1) - before)) AS BIGINT) END AS taken FROM b"""
