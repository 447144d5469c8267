"""Main text of web pages by consensus host paths.

Each page's containers are scored by their prose and the best one is lifted to
the article around it; the generalised tag-class paths are votes, summed per
host in Spark; then every page is extracted again from all containers that its
host's first fitting path names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.url_filter import host_of
from weftgraph.plans.stage import materialize

# Element names of the markup language, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title iframe object svg canvas nav aside button select textarea menu dialog footer audio video map".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
ROOT = "#root"
CONTAINERS = frozenset(("article main section div td body " + ROOT).split())
PROSE = frozenset(("p pre blockquote li h1 h2 h3 h4 h5 h6 dd div article section td main body " + ROOT).split())
# Elements that a new one of their kind closes, and the elements within which that holds.
CLOSED_WITHIN = {
    "p": BLOCKS - {"p"}, "li": frozenset(("ul", "ol", "menu")), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")),
    "dd": frozenset(("dl", "select")), "dt": frozenset(("dl", "select")), "option": frozenset(("dl", "select")),
}
# Words of which a class or id that marks page furniture is made up.
NOISE = re.compile(
    r"(?:ads?|advert\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|promo\w*|sponsor\w*|newsletter|subscribe|signup|login|popup|modal|"
    r"overlay|widgets?|pagination|pager|toolbar|skip|hidden)",
    re.I,
)
# Those of furniture that is often longer than the article.
LONG = re.compile(r"cookies?|consent|gdpr|notices?|comments?|commentlist|disqus|replies|respond", re.I)
# Those that mark furniture together with a place, a shape or a number too (comment-list, ad-slot-3, site-nav).
PAIRED = re.compile(
    r"(?:ads?|advert\w*|cookies?|consent|gdpr|sidebar|menu|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|disqus|replies|respond|"
    r"share|sharing|social|related|recommended|promo\w*|sponsor\w*|newsletter|subscribe|signup|login|popup|modal|pagination|pager)",
    re.I,
)
# The words for such a place or shape.
ATTACHED = re.compile(
    r"(?:area|articles?|bars?|block|body|bottom|box|buttons?|column|container|dialog|feed|form|global|group|icons?|inner|items?|left|links?|list|main|outer|page|panel|"
    r"posts?|primary|rail|reader|right|row|secondary|section|site|slot|stories|thread|top|unit|user|wrap|wrapper|zone|\d+(?:x\d+)?)",
    re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
UNENDED = re.compile("<[!?/a-zA-Z]")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
ARTICLES = frozenset(("article", "main"))
VOTE = "host string, path string, score double"
#: Names that a path spells out; above them it is only hashed.
SPELLED = 24


@dataclass(frozen=True)
class ExtractParams:
    """``winners`` paths are kept per host; a container's paragraph gives its parent 1 and its grandparent ``decay``.

    Outside of any article, a winner is lifted to an ancestor that holds more
    than ``spare`` of its prose elsewhere.
    """

    winners: int = 3
    decay: float = 0.5
    spare: float = 0.1


@lru_cache(maxsize=4096)
def softness(called: str) -> int:
    """Of an element's classes and id: 2 if one names furniture that may be long, 1 if one names other furniture, else 0."""
    marks: list[str] = []
    for name in called.split():
        words = re.split("[-_]+", name.strip("-_"))
        others = [x for x in words if not NOISE.fullmatch(x)]
        if not others or (any(map(PAIRED.fullmatch, words)) and all(map(ATTACHED.fullmatch, others))):
            marks += words
    return 2 if any(map(LONG.fullmatch, marks)) else int(bool(marks))


class Node:
    """``hard`` elements are never text; ``soft`` ones are furniture by name, or forms: 1 unless they hold the page (``mark``), 2 even then.

    What is asked of its ancestors is kept in each node, so deep pages cost no
    climbing: the hash of the path to it, the nearest elements that a new one
    would close (``open``), the block, the prose block and the container that
    it lies in (itself, if it is one).
    """

    __slots__ = ("tag", "name", "parent", "items", "hard", "soft", "noise", "depth", "key", "open", "block", "para", "holder", "in_article", "inline", "nodes")

    def __init__(self, tag: str, name: str, parent: "Node | None", hard: bool, soft: int = 0) -> None:
        self.tag, self.name, self.parent, self.items, self.hard, self.soft, self.noise, self.inline = tag, name, parent, [], hard, soft, hard, None
        self.nodes: list[Node] | None = None  # of the root: all elements in page order
        if parent is None:
            self.depth, self.key, self.open, self.in_article = 0, 0, {}, False
            self.block = self.para = self.holder = self
            return
        self.depth, self.in_article = parent.depth + 1, parent.in_article or tag in ARTICLES
        self.key = xxhash.xxh64_intdigest(name, parent.key)
        self.block = self if tag in BLOCKS else parent.block
        self.para = self if tag in PROSE else parent.para
        self.holder = self if tag in CONTAINERS else parent.holder
        kept = parent.open
        if kept and (tag in BLOCKS or tag == "select"):
            kept = {t: x for t, x in kept.items() if tag not in CLOSED_WITHIN[t]}
        self.open = {**kept, tag: self} if tag in CLOSED_WITHIN else kept

    def path(self) -> str:
        """The names from the root; of a deep element the last ones, and a hash of all."""
        names, node = [], self
        while node.parent is not None and len(names) < SPELLED:
            names.append(node.name if len(node.name) <= 200 else f"{node.name[:200]}#{xxhash.xxh64_hexdigest(node.name)}")
            node = node.parent
        text = ">".join(reversed(names))
        return text if node.parent is None else f"#{self.key:016x}>{text}"


class _Builder(HTMLParser):
    """A forgiving tree: unclosed paragraphs and items close, stray end tags are ignored.

    Time is linear in the page: end tags without an open element are known by
    counts, and each step up closes an element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node(ROOT, "", None, False)
        self.root.nodes = [self.root]
        self.blocks: dict[str, int] = {}  # open block elements by tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and (held := self.at.open.get("p")) is not None:
            self._leave(held)
        if tag in CLOSED_WITHIN and (held := self.at.open.get(tag)) is not None:
            self._leave(held)
        parent, a = self.at, {k: v or "" for k, v in attrs}
        hard = parent.hard or tag in DROPPED or (tag == "header" and not parent.in_article)
        soft, name = int(tag == "form"), tag
        if a:
            role = a.get("role", "").lower()
            hard = hard or "hidden" in a or a.get("aria-hidden") == "true" or role in ROLES or bool(HIDDEN.search(a.get("style", "")))
            called = a.get("class", "")
            if (called or "id" in a) and tag not in ("html", "body") and tag not in ARTICLES:
                soft = softness(f"{called} {a.get('id', '')}") or soft
            soft = soft or int(role == "form")
            if called:
                name = ".".join([tag, *sorted(set(re.sub(r"\d+", "N", called).replace(">", "_").lower().split()))])
        node = Node(tag, name, parent, hard, soft)
        parent.items.append(node)
        self.root.nodes.append(node)
        if tag not in VOID:
            self.at = node
            if tag in BLOCKS:
                self.blocks[tag] = self.blocks.get(tag, 0) + 1
            else:
                counts = node.block.inline
                if counts is None:
                    counts = node.block.inline = {}
                counts[tag] = counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        # an inline end tag does not close the blocks around it
        if tag in BLOCKS:
            if not self.blocks.get(tag):
                return
        elif not (self.at.block.inline or {}).get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._leave(node)

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)

    def _leave(self, node: Node) -> None:
        """Close all open elements down from the current one to ``node``."""
        while True:
            x = self.at
            counts = self.blocks if x.tag in BLOCKS else x.block.inline
            counts[x.tag] -= 1
            self.at = x.parent
            if x is node:
                return


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    if UNENDED.match(builder.rawdata):  # a comment or tag that the page's end cuts off is no text
        builder.rawdata = ""
    builder.close()
    mark(builder.root)
    return builder.root


def prose(root: Node) -> dict[int, int]:
    """Characters outside links and noise below each element."""
    nodes = root.nodes
    held = {id(x): 0 if x.noise or x.tag == "a" else sum(len(t.strip()) for t in x.items if isinstance(t, str)) for x in nodes}
    for x in reversed(nodes):
        if x.parent is not None:
            held[id(x.parent)] += held[id(x)]
    return held


def mark(root: Node, names: bool = True) -> None:
    """Set ``noise``: hard elements, with ``names`` also soft ones, and all below either.

    An element of ``soft`` 1 that holds most of the page's prose is none,
    unless an article with prose lies outside it.
    """
    nodes = root.nodes
    for x in nodes:
        x.noise = x.hard
    if not names or not any(x.soft and not x.hard for x in nodes):
        return
    held = prose(root)
    above: dict[int, int] = {}  # articles with prose around each element, itself included
    below: dict[int, int] = {}  # and in it, itself excluded
    for x in nodes:
        own = int(x.tag in ARTICLES and held[id(x)] > 0)
        above[id(x)] = own + (above[id(x.parent)] if x.parent is not None else 0)
        below[id(x)] = 0
    for x in reversed(nodes):
        if x.parent is not None:
            below[id(x.parent)] += below[id(x)] + int(x.tag in ARTICLES and held[id(x)] > 0)
    articles = below[id(root)]
    for x in nodes:
        alone = above[id(x)] + below[id(x)] == articles
        most = x.soft == 1 and 2 * held[id(x)] > held[id(root)] and alone
        x.noise = x.hard or (x.soft > 0 and not most) or (x.parent is not None and x.parent.noise)


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def scores(root: Node, decay: float, links: bool = False) -> dict[int, tuple[Node, float]]:
    """Prose of each container: characters of its paragraphs outside furniture, and outside links unless ``links``."""
    found: dict[int, tuple[Node, float]] = {}

    def add(node: Node, x: float) -> None:
        if not node.noise:
            found[id(node)] = (node, found.get(id(node), (node, 0.0))[1] + x)

    for node in root.nodes:
        if node.noise or (node.tag == "a" and not links):
            continue
        chars = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if not chars:
            continue
        holder = node.para.holder
        add(holder, chars)
        if holder.parent is not None:
            add(holder.parent.holder, chars * decay)
    return found


def best(root: Node, params: ExtractParams) -> Node | None:
    """The container of the most prose, lifted; if there is none, as if links were prose, and then as if there were no names."""
    found = scores(root, params.decay) or scores(root, params.decay, links=True)
    if not found:
        mark(root, names=False)
        found = scores(root, params.decay) or scores(root, params.decay, links=True)
    # ties go to the container that comes first in the page
    return lift(root, max(found.values(), key=lambda x: x[1])[0], params.spare) if found else None


def lift(root: Node, node: Node, spare: float) -> Node:
    """The outermost article around a container; without one, the outermost container that adds prose."""
    around = [x for x in _up(node) if x.tag in CONTAINERS]
    articles = [x for x in around if x.tag in ARTICLES]
    if articles:
        return articles[-1]
    held = prose(root)
    for x in around:
        if held[id(x)] - held[id(node)] > spare * held[id(x)]:
            node = x
    return node


def text_of(top: Node) -> str:
    """Blocks of a container in page order, one a line, white space collapsed."""
    lines: list[str] = []
    held: list[str] = []

    def end() -> None:
        line = " ".join("".join(held).split())
        if line:
            lines.append(line)
        held.clear()

    stack: list[object] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif x.noise and x is not top:
            held.append(" ")
        elif x.tag in BLOCKS:
            end()
            stack.append(None)
            stack.extend(reversed(x.items))
        else:
            if x.tag in ("br", "td", "th", "img"):
                held.append(" ")
            stack.extend(reversed(x.items))
    end()
    return "\n".join(lines)


def text_at(root: Node, path: str) -> str:
    """The text of all containers with this path, in page order."""
    hashed = path.startswith("#")
    at = int(path[1:17], 16) if hashed else path.count(">") + 1 if path else 0
    fits = [x for x in root.nodes if (x.key if hashed else x.depth) == at and x.tag in CONTAINERS and not x.noise and x.path() == path]
    return "\n".join(text for x in fits if (text := text_of(x)))


def extract_one(html: str | None, winners: list[str], params: ExtractParams) -> tuple[str, str]:
    """(text, path used): from the first of the winning paths that the page has, else from its own best container."""
    root = parse(html)
    for path in winners:
        if text := text_at(root, path):
            return text, path
    node = best(root, params)
    return (text_at(root, node.path()), node.path()) if node is not None else ("", "")


def host_paths(pages: DataFrame, params: ExtractParams = ExtractParams(), url: str = "url", html: str = "html") -> DataFrame:
    """``(host, paths)``: the winning paths of each host, most votes first, ties by path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            votes: dict[tuple[str, str], float] = {}
            for h, page in zip(pdf["host"], pdf["html"]):
                node = best(parse(page), params)
                if node is not None:
                    votes[h, node.path()] = votes.get((h, node.path()), 0.0) + 1.0
            yield pd.DataFrame([(h, p, s) for (h, p), s in votes.items()], columns=["host", "path", "score"])

    cast = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInPandas(run, VOTE)
    counted = cast.groupBy("host", "path").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "path"))
    top = counted.withColumn("r", rank).filter(F.col("r") <= params.winners)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, params: ExtractParams = ExtractParams(), url: str = "url", html: str = "html") -> DataFrame:
    """Every row of ``pages`` without ``html``, with ``text`` and ``text_path``.

    Null or empty html, and pages without any text, give an empty text; a page
    without a body, or of bare text, is its own container. Pages without a
    host share the host "". Of containers that tie the first of the page
    wins, of paths that tie the first by text. Repeated rows stay, and each
    votes; an empty table gives an empty table. Whole pages are read in time
    linear in their length, however deep they nest. The table of winning paths
    is written first: Spark broadcasts it if its files are under the broadcast
    threshold and joins by shuffle beyond. Columns named like the added ones
    are replaced.
    """
    winners = materialize(host_paths(pages, params, url, html), "host-paths")
    rest = [c for c in pages.columns if c not in (html, "text", "text_path")]
    left = pages.select(*rest, F.col(html).alias("__html"), host_of(F.col(url)).alias("__host"))
    joined = left.join(winners.select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "__host", "left").drop("__host")
    schema = pages.select(*rest).schema.add("text", "string").add("text_path", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract_one(h, p or [], params) for h, p in zip(batch.column("__html").to_pylist(), batch.column("__paths").to_pylist())]
            made = [pa.array([x[i] for x in got], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, "text", "text_path"])

    return joined.mapInArrow(run, schema)
