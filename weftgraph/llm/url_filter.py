"""URL filter: explicit rules, and a template tree learnt per host from labelled urls.

All DataFrame operations. Path segments are put on a tree per host. Rare
children of a node with many rare children are generalised to ``*``; children
whose share of bad pages does not differ from their siblings' by more than
chance are merged into ``*`` too. A template is blocked if its smoothed share
of bad labelled urls reaches a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.stage import materialize

#: (pattern, verdict): a host suffix and a path prefix.
DEFAULT_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
STAR = "*"


@dataclass(frozen=True)
class TreeParams:
    """When a child of a node becomes ``*``, and when a template is blocked.

    A child is variable if it holds at most ``max_repeat`` rows and so do at
    least ``min_children`` children of its node. Siblings are merged if |z| of
    their bad share against the rest of the node is under ``z``. Purity is
    (bad + prior * strength) / (n + strength), ``prior`` the smoothed share of
    bad rows among all labelled ones; ``block_at`` blocks.
    """

    min_children: int = 8
    max_repeat: float = 4.0
    z: float = 2.58
    strength: float = 8.0
    block_at: float = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or no ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=DEFAULT_RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null if none): equal host or subdomain, path prefix.

    Of rules of equal length the earlier in text order wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        h, slash, p = text.partition("/")
        h = h.lower()
        fits = (host == h) | F.endswith(host, F.lit("." + h))
        fits = fits & F.startswith(path, F.lit(slash + p)) if slash else fits
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments, all of them; one that is itself ``*`` is written ``%2A``."""
    parts = F.split(F.regexp_replace(path, "^/|/$", ""), "/")
    return F.transform(parts, lambda s: F.when(s == STAR, F.lit("%2A")).otherwise(s))


def leaves_of(marked: DataFrame) -> DataFrame:
    """Distinct segment lists of ``marked`` (host, path, bad 0/1/null) with their counts.

    A hot host costs as many rows from here on as it has distinct lists.
    """
    return (
        marked.withColumn("__s", segments(F.col("path")))
        .groupBy("host", "__s")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("bad"))
    )


def learn_tree(marked: DataFrame, params: TreeParams = TreeParams()) -> tuple[DataFrame, DataFrame]:
    """``(host, __s, template)`` of every segment list and ``(host, template, n, bad, purity)``.

    Unlabelled urls (bad null) shape the tree but do not count in purity.
    """
    shaped = generalise(leaves_of(marked), params)
    tree = shaped.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    prior = tree.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))  # one row
    purity = (F.col("bad") + F.col("prior") * params.strength) / (F.col("n") + params.strength)
    return shaped.select("host", "__s", "template"), tree.crossJoin(F.broadcast(prior)).select("host", "template", "n", "bad", purity.alias("purity"))


def common_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def generalise(leaf: DataFrame, params: TreeParams) -> DataFrame:
    """Add ``template`` to distinct segment lists ``(host, __s, rows, n, bad)``, branching by branching from the root.

    In each round the children of a node are counted, and the decision about a
    child is joined back on (host, prefix so far, segment). Below a child that
    stays as it is, all segments that its lists share are taken at once (what
    the smallest and the largest list share, all share): a lone child is never
    generalised, so no decision is skipped. Rounds follow the branchings along
    a path, not the length of the longest url; they end when no list has a
    segment left. Lists are written in each round, or the plan would grow with
    a power of the rounds; finished ones are not written again.
    """
    start = leaf.withColumns({"__prefix": F.lit(""), "__rest": F.col("__s")})
    cur, done = materialize(start, "url-tree"), []
    while True:
        done.append(cur.filter(F.size("__rest") == 0))
        cur = cur.filter(F.size("__rest") > 0)
        if cur.isEmpty():
            break
        cur = cur.withColumn("__seg", F.get("__rest", F.lit(0)))
        child = cur.groupBy("host", "__prefix", "__seg").agg(
            F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("__rest").alias("lo"), F.max("__rest").alias("hi")
        )
        rare = F.col("rows") <= params.max_repeat
        node = child.groupBy("host", "__prefix").agg(
            F.count(F.lit(1)).alias("children"), F.count(F.when(rare, 1)).alias("rare"), F.sum("n").alias("pn"), F.sum("bad").alias("pbad")
        )
        m = F.col("pn") - F.col("n")
        pooled = F.col("pbad") / F.greatest("pn", F.lit(1))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("n", F.lit(1)) + 1 / F.greatest(m, F.lit(1))))
        gap = F.abs(F.col("bad") / F.greatest("n", F.lit(1)) - (F.col("pbad") - F.col("bad")) / F.greatest(m, F.lit(1)))
        variable = rare & (F.col("rare") >= params.min_children)
        alike = (F.col("children") > 1) & ((spread == 0) | (F.col("n") == 0) | (m == 0) | (gap < params.z * spread))
        merge = variable | alike
        said = child.join(node, ["host", "__prefix"]).select(
            "host", "__prefix", "__seg", merge.alias("__star"), F.when(merge, F.lit(1)).otherwise(common_length(F.col("lo"), F.col("hi"))).alias("__take")
        )
        taken = F.when(F.col("__star"), F.lit(STAR)).otherwise(F.array_join(F.slice("__rest", F.lit(1), F.col("__take")), "/"))
        moved = cur.join(said, ["host", "__prefix", "__seg"]).withColumns({
            "__prefix": F.concat("__prefix", F.lit("/"), taken),
            "__rest": F.slice("__rest", F.col("__take") + 1, F.size("__rest") - F.col("__take")),
        })
        cur = materialize(moved.select("host", "__s", "rows", "n", "bad", "__prefix", "__rest"), "url-tree")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("__rest").withColumnRenamed("__prefix", "template")


def judge(pages: DataFrame, labels: DataFrame, rules=DEFAULT_RULES, params: TreeParams = TreeParams(), url: str = "url") -> DataFrame:
    """Add ``host, path, rule, template, purity, verdict`` to every row of ``pages``.

    ``labels`` is (url_key, bad): one row a labelled url, keyed as
    ``pages.url_key``. A rule decides; else the template's block decides; a
    url whose template has no labelled evidence is allowed. Null and empty
    urls get the host and path of nothing and are judged like any other host.
    Urls may be of any length. Repeated rows stay, and each counts in the
    tree. An empty table gives an empty table. Columns of ``pages`` with the
    added names are replaced, others are kept.
    """
    rows = pages.drop("host", "path", "rule", "template", "purity", "verdict", "bad")
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__says": says})
    marked = rows.select("host", "path", "url_key").join(labels, "url_key", "left")
    lists, tree = learn_tree(marked, params)
    leaves = lists.join(tree.select("host", "template", "purity", F.col("n").alias("__n")), ["host", "template"])
    out = rows.withColumn("__s", segments(F.col("path"))).join(leaves, ["host", "__s"], "left")
    method = F.when((F.col("__n") > 0) & (F.col("purity") >= params.block_at), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("__says", method)).drop("__says", "__s", "__n")


def judge_sql(key: str, params: TreeParams = TreeParams(), rules=DEFAULT_RULES, levels: int = 8) -> str:
    """The same verdicts as plain SQL over ``pages`` and ``labels``, one level of the tree after the other.

    ``key`` is an expression over ``path`` that gives a page's labelled
    document. Paths may have ``levels`` segments.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fits, says = [], []
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        when = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        fits.append(f"{when} THEN '{text}'")
        says.append(f"{when} THEN '{verdict}'")
    steps = []
    for i in range(levels):
        seg = f"s[{i + 1}]"
        steps.append(f"""c{i} AS MATERIALIZED (SELECT host, prefix, {seg} AS seg, sum(rows) AS rows, sum(n) AS n, sum(bad) AS bad FROM l{i} WHERE len(s) > {i} GROUP BY ALL),
m{i} AS MATERIALIZED (SELECT host, prefix, count(*) AS children, count(*) FILTER (WHERE rows <= {params.max_repeat}) AS rare, sum(n) AS pn, sum(bad) AS pbad FROM c{i} GROUP BY ALL),
g{i} AS (SELECT host, prefix, seg, rows, children, rare, n, pn - n AS m, pbad / greatest(pn, 1) AS pooled, abs(bad / greatest(n, 1) - (pbad - bad) / greatest(pn - n, 1)) AS gap
  FROM c{i} JOIN m{i} USING (host, prefix)),
z{i} AS (SELECT *, sqrt(pooled * (1 - pooled) * (1 / greatest(n, 1) + 1 / greatest(m, 1))) AS spread FROM g{i}),
d{i} AS MATERIALIZED (SELECT host, prefix, seg, (rows <= {params.max_repeat} AND rare >= {params.min_children})
  OR (children > 1 AND (spread = 0 OR n = 0 OR m = 0 OR gap < {params.z} * spread)) AS star FROM z{i}),
l{i + 1} AS MATERIALIZED (SELECT l{i}.host, s, rows, n, bad, CASE WHEN len(s) <= {i} THEN l{i}.prefix WHEN star THEN l{i}.prefix || '/*' ELSE l{i}.prefix || '/' || {seg} END AS prefix
  FROM l{i} LEFT JOIN d{i} ON l{i}.host = d{i}.host AND l{i}.prefix = d{i}.prefix AND {seg} = d{i}.seg)""")
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY 1),
k AS MATERIALIZED (SELECT h.*, bad, list_transform(string_split(regexp_replace(path, '^/|/$', '', 'g'), '/'), lambda x: CASE WHEN x = '*' THEN '%2A' ELSE x END) AS s,
  CASE {' '.join(fits)} END AS rule, CASE {' '.join(says)} END AS says FROM h LEFT JOIN b ON b.doc_id = {key}),
l0 AS MATERIALIZED (SELECT host, s, CAST(count(*) AS DOUBLE) AS rows, CAST(count(bad) AS DOUBLE) AS n, CAST(sum(coalesce(bad, 0)) AS DOUBLE) AS bad, '' AS prefix FROM k GROUP BY ALL),
{','.join(steps)},
t AS (SELECT host, prefix, sum(n) AS n, sum(bad) AS bad FROM l{levels} GROUP BY ALL), pr AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS prior FROM t),
v AS (SELECT host, prefix, n, (bad + prior * {params.strength}) / (n + {params.strength}) AS purity FROM t, pr)
SELECT page_id, k.host, path, rule, coalesce(says, CASE WHEN v.n > 0 AND purity >= {params.block_at} THEN 'block' ELSE 'allow' END) AS verdict, v.prefix AS template, round(purity, 9) AS purity
FROM k JOIN l{levels} l ON l.host = k.host AND l.s = k.s JOIN v ON v.host = l.host AND v.prefix = l.prefix"""
