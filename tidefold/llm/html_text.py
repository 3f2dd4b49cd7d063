"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of elements; text runs are its leaves. Every node is content or not, a hidden binary variable.
Node potentials come from features of the node (its tag, words of class, id and role, link density, length, commas),
pair potentials from how often child and parent share a label. Two sweeps of sum-product messages, upward and then
downward, give each leaf's exact marginal; leaves that are more likely content than not are joined by block. Below an
element whose name says outright that it is no content, the pair potential is firm and nothing is passed upward.

Training: a bounded sample of pages (``fit_pages``, chosen by a hash of id and address) is labelled by what its markup
says outright: elements whose names say navigation, header, footer, advert, form or comment are no content, the main
article is. The counts of features and label pairs over these pages, smoothed, are the potentials. Names are features
among others afterwards, so on pages without telling names the text features and the neighbours decide.

Recovery: closed void elements, unclosed paragraphs and list items, stray and crossing end tags, unclosed tags, comments
and raw-text elements; time is linear in a page, whatever is broken in it. Defined results: null, empty and textless pages give an empty text. Repeated rows each get the
same text. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Classes of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
#: Elements an implied end does not reach beyond.
SCOPE = frozenset("table ul ol dl article section div body html nav aside main".split())
#: Names of what is not the article, and of what is.
OUTSIDE_TAGS = frozenset("nav header footer aside form button dialog menu".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar "
    "side aside related share sharing social cookie cookies consent notice notices popup modal newsletter subscribe signup login form search comment "
    "comments reply replies disqus copyright legal widget toolbar pagination pager contentinfo complementary alert".split()
)
INSIDE_TAGS = frozenset("article main".split())
INSIDE_NAMES = frozenset("article content main post entry story body text maincontent articlebody".split())

#: Elements that hold everything and say nothing.
CONTAINERS = frozenset(("#root", "html", "body"))
#: Elements that serve menus and articles alike; only their names, links and texts count.
STRUCTURE = frozenset("div section span ul ol li dl dt dd table thead tbody tfoot tr td th".split())
#: Tags that are features of their own; all others are one feature, so the features have a bound.
TAGS = VOID | RAW | INLINE | SCOPE | STRUCTURE | OUTSIDE_TAGS | INSIDE_TAGS | frozenset(
    "p pre h1 h2 h3 h4 h5 h6 blockquote figure figcaption address details summary hgroup fieldset legend option optgroup datalist output video audio head caption center".split()
)
#: Log odds of an element that is named as no content; and how firmly what lies below it follows.
OUTRIGHT, FIRM = -12.0, 20.0

#: Quotes count after an equals sign. No character is looked at twice: a tag without its end ends before the next one.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    names: frozenset = frozenset()
    children: list[Node] = field(default_factory=list)
    text: str | None = None  # of a leaf
    block: int = 0  # of a leaf: runs of one block belong together
    length: int = 0
    linked: int = 0  # of length, what lies in links


def attribute_names(attributes: str) -> frozenset:
    if not attributes:
        return frozenset()
    found = [v for m in ATTRIBUTE.finditer(attributes) for v in m.groups()[1:] if v]
    return frozenset(p.lower() for v in found for p in NAME_PART.findall(v))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree, and its nodes with parents before children."""
    root = Node("#root", None)
    nodes, block, at, end, links = [root], 0, 0, len(page), 0
    closer: dict[str, re.Pattern] = {}
    # The open elements; and the places of each tag, of scopes and of blocks among them, so that nothing is searched for.
    stack, places, scopes, blocks = [root], {}, [0], [0]

    def leaf(raw: str, space: bool = False) -> None:
        if raw and (space or not raw.isspace() or nodes[-1].block == block):
            node = Node("#text", stack[-1], text=raw, block=block, linked=links)
            stack[-1].children.append(node)
            nodes.append(node)

    def close(depth: int) -> None:
        """All but the outermost depth elements end."""
        while len(stack) > depth:
            places[stack.pop().tag].pop()
            for inner in (scopes, blocks):
                if inner[-1] == len(stack):
                    inner.pop()

    for found in iter(lambda: MARKUP.search(page, at), None):
        leaf(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            # Inline elements are no nodes of their own: their text belongs to the block around them.
            if tag == "a":
                links = 0 if closing else 1
            names = frozenset() if closing else attribute_names(attributes)
            if not names & OUTSIDE_NAMES and not (closing and stack[-1].tag == tag):
                if tag == "br":
                    leaf(" ", True)
                continue
        else:
            block, links = block + 1, 0
        if closing:
            own = places.get(tag)
            if own and (tag not in INLINE or own[-1] > blocks[-1]):
                close(own[-1])
            continue
        if tag not in INLINE:  # open paragraphs and inline elements end before a block
            last = max((places[t][-1] for t in (*CLOSES.get(tag, ()), "p") if places.get(t)), default=0)
            if last > scopes[-1]:
                close(last)
        node = Node(tag, stack[-1], attribute_names(attributes))
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW and not attributes.endswith("/"):
            pattern = closer.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I))
            stop = pattern.search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append(node)
    leaf(page[at:])
    return root, nodes


def measure(nodes: list[Node]) -> None:
    for node in nodes:
        if node.text is not None:
            node.text = SPACE.sub(" ", entities.unescape(node.text))
            node.length = len(node.text) if node.text != " " else 0
            node.linked *= node.length
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    # A name such as "has-sidebar" says nothing about an element that holds the article itself.
    holds: set[int] = set()
    for node in reversed(nodes):
        article = node.tag in INSIDE_TAGS and not node.names & OUTSIDE_NAMES and 10 * node.length >= 3 * nodes[0].length
        if article or id(node) in holds or node.tag in CONTAINERS:
            node.names -= OUTSIDE_NAMES
            if node.parent is not None and (article or id(node) in holds):
                holds.add(id(node.parent))


def features(node: Node) -> list[str]:
    if node.text is not None:
        commas = min(sum(map(node.text.count, ",.;:")), 4)
        size = [f"text {min(node.length.bit_length(), 9)} {commas}"] if node.length else []
        return size if node.parent.tag in STRUCTURE or node.parent.tag in CONTAINERS else [*size, f"in {node.parent.tag if node.parent.tag in TAGS else 'other'}"]
    if node.tag in CONTAINERS:
        return []
    out = [] if node.tag in STRUCTURE else [f"tag {node.tag if node.tag in TAGS else 'other'}"]
    out += [f"name {n}" for n in node.names if n in OUTSIDE_NAMES or n in INSIDE_NAMES]
    if node.length:
        out.append(f"links {4 * node.linked // node.length} {min(node.length.bit_length(), 9)}")
    return out


def told(node: Node, above: int | None) -> int | None:
    """What the markup says outright: 1 content, 0 not, None nothing; inherited from above."""
    if above == 0 or node.tag in OUTSIDE_TAGS or node.names & OUTSIDE_NAMES:
        return 0
    if node.tag in INSIDE_TAGS or node.names & INSIDE_NAMES and node.tag != "body":
        return 1
    return above


def labels(nodes: list[Node]) -> list[int | None]:
    """Outright labels by node; on a page with an article, whatever is no part of it is no content."""
    given: dict[int, int | None] = {}
    out = []
    for node in nodes:
        label = told(node, given.get(id(node.parent)) if node.parent is not None else None)
        given[id(node)] = label
        out.append(label)
    return [x or 0 for x in out] if 1 in out else out


def training_counts(page: str) -> Counter:
    """(what, label) -> n of one page; nothing if the page tells nothing."""
    counts: Counter = Counter()
    _, nodes = parse(page)
    measure(nodes)
    given = labels(nodes)
    if 1 not in given:
        return counts
    by_id = {id(n): x for n, x in zip(nodes, given)}
    for node, label in zip(nodes, given):
        counts["label", label] += 1
        for f in features(node):
            counts[f, label] += 1
        if node.parent is not None:
            counts[f"parent {by_id[id(node.parent)]}", label] += 1
    return counts


@dataclass
class Model:
    """weights: log odds for content of each feature; same: log potential of a parent and child of one label."""

    weights: dict[str, float]
    same: float


def model_of(counts: dict[tuple[str, int], int], smooth: float = 2.0) -> Model:
    total = [counts.get(("label", k), 0) + smooth for k in (0, 1)]
    weights = {}
    for f in {f for f, _ in counts}:
        if f != "label" and not f.startswith("parent "):
            p = [(counts.get((f, k), 0) + smooth) / (total[k] + 2 * smooth) for k in (0, 1)]
            weights[f] = math.log(p[1] / p[0])
    for n in OUTSIDE_TAGS:
        weights[f"tag {n}"] = min(weights.get(f"tag {n}", 0.0), OUTRIGHT)
    for n in OUTSIDE_NAMES:
        weights[f"name {n}"] = min(weights.get(f"name {n}", 0.0), OUTRIGHT)
    for n in INSIDE_TAGS:
        weights[f"tag {n}"] = max(weights.get(f"tag {n}", 0.0), -OUTRIGHT / 2)
    agree = sum(counts.get((f"parent {k}", k), 0) for k in (0, 1)) + smooth
    differ = sum(counts.get((f"parent {k}", 1 - k), 0) for k in (0, 1)) + smooth
    return Model(weights, min(max(0.5 * math.log(agree / differ), 0.5), 3.0))


def message(odds: float, same: float) -> float:
    """Log odds that a neighbour with these log odds sends over an edge."""
    a, b = max(odds + same, -same), max(odds - same, same)
    return a + math.log1p(math.exp(-abs(odds + 2 * same))) - b - math.log1p(math.exp(-abs(odds - 2 * same)))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Log odds of content for each node: exact sum-product on the tree, in two sweeps."""
    number = {id(n): k for k, n in enumerate(nodes)}
    parent = [number[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    belief = [sum(model.weights.get(f, 0.0) for f in features(n)) for n in nodes]
    outside = [n.tag in OUTSIDE_TAGS or bool(n.names & OUTSIDE_NAMES) for n in nodes]
    firm = [model.same] * len(nodes)
    for k in range(1, len(nodes)):
        if outside[parent[k]]:
            outside[k], firm[k] = True, FIRM
    sent = [0.0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if not outside[parent[k]]:  # below a named element, messages only go down
            sent[k] = message(belief[k], firm[k])
            belief[parent[k]] += sent[k]
    for k in range(1, len(nodes)):
        belief[k] += message(belief[parent[k]] - sent[k], firm[k])
    return belief


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    measure(nodes)
    blocks: list[str] = []
    last = None
    for node, odds in zip(nodes, marginals(nodes, model)):
        if node.text is not None and odds > 0:
            if node.block == last:
                blocks[-1] += node.text
            else:
                blocks.append(node.text)
            last = node.block
    return "\n".join(b for b in (SPACE.sub(" ", x).strip() for x in blocks) if b)


def count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            total.update(training_counts(page.as_py() or ""))
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
        names=["feature", "label", "n"],
    )


def fit(pages: DataFrame, html: str, fit_pages: int) -> Model:
    """Features are known tags, fixed names and sizes, so the counts that come to the driver have a bound of their own."""
    rows = pages.select("id", F.col(html).alias("html")).where("html IS NOT NULL")
    share = min(1.0, fit_pages / max(rows.count(), 1))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("html")
    counts = sample.mapInArrow(count_pages, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    return model_of({(f, x): n for f, x, n in counts.collect()})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", fit_pages: int = 2000) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages."""
    ship(pages.sparkSession)
    model = fit(pages.select(F.struct(page_id, url).alias("id"), html), html, fit_pages)
    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return chosen.mapInArrow(
        of, T.StructType([chosen.schema["page_id"], chosen.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    )
