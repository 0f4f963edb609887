"""Main text of web pages by a graphical model on the DOM tree.

Every block is content or not. A node's features (tag, classes and their words, classes of the element around it, share of
link text, sentences, siblings of its kind) give it a potential, every parent-child edge another, and sum-product message
passing, up from the leaves and down from the root, gives each node's exact marginal. Both potentials are learnt from pages
whose tags alone say which part is the article; words that name page furniture are prior odds, to which what is learnt adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches, sampled

#: Pages whose markup trains the potentials: those with the smallest hash of id and html, about so many.
TRAINING_PAGES = 2000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe canvas audio video select datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of the key closes when one of them is open nearest (tags whose end may be left out).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"br", "body", "html", "option", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}

#: Words in class, id and role that stand for page furniture or for content: prior counts of the model.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments consent contact "
    "cookie cookies copyright disclaimer discussion disqus footer form gdpr header legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion reader "
    "recommend recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar tracking warning widget complementary contentinfo".split()
)
CONTENT = frozenset("article content entry main post story".split())
FURNITURE_TAGS = frozenset("nav header footer aside form button input textarea label dialog menu fieldset legend".split())
CONTENT_TAGS = frozenset("article main".split())
#: Furniture words that also name content when they are part of a longer class name ("contact-lens", "story-share-wrap"): such
#: a name tells only of an element without a sentence, or with links for a quarter of its text.
AMBIGUOUS = frozenset("contact form reader search share skip social tracking".split())
#: Prior log odds of telling tags and words, of what stands inside furniture (more than the looks of all its paragraphs can
#: say: comments are prose), of ambiguous words, and of a few other features.
TELLING, INSIDE, HINT = 7.0, 12.0, 1.5
PLAIN_PRIORS = {"tag:p": 0.5, "links:0": 0.25, "links:3": -1.0, "prose:more": 1.0, "prose:one": 0.5}
#: Smoothing of learnt odds: of features that name a place in a template, as a share of the training pages (a place occurs
#: about once a page); of those that every page has, as a share of the training nodes.
PLACE, COMMON = 0.02, 0.15
#: Nodes in which a feature must be seen to be believed half.
BELIEF = 20.0
#: Prior counts of edges: child furniture or content, under furniture and under content.
EDGES = ((1000.0, 3.0), (20.0, 400.0))
#: The end of a sentence.
STOP = re.compile(r"[.!?\u3002\uFF01\uFF1F](?=\s|$)")
#: Tags that frame a page and say nothing about their text.
FRAME = frozenset(("#page", "html", "body"))


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset[str] = frozenset()
    whole: frozenset[str] = frozenset()
    telling: bool = False
    frames: bool = False
    own: int = 0
    stops: int = 0
    sentences: int = 0
    text: int = 0
    linked: int = 0
    within: str = ""
    features: list[str] = field(default_factory=list)


_WORDS, _HUMP = re.compile("[a-z]+"), re.compile("([a-z])([A-Z])")


class _Tree(HTMLParser):
    """Nodes in document order, and the pieces of text between block borders with the node that each belongs to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1)]
        self.open = [0]
        self.pieces: list[tuple[int, str]] = []
        self.hidden = 0
        self.links = 0
        self.tags: Counter[str] = Counter()  # of open elements

    def _start(self, tag: str, attributes) -> None:
        words, whole, telling = set(), set(), False
        for name, value in attributes:
            if value and name in ("class", "id", "role"):
                for one in value.split():
                    parts = set(_WORDS.findall(_HUMP.sub(r"\1 \2", one).lower()))
                    words |= parts
                    whole.add(one.lower())
                    found = parts & FURNITURE
                    telling = telling or bool(found) and (bool(found - AMBIGUOUS) or found == parts)
        self.nodes.append(Node(tag, self.open[-1], frozenset(words), frozenset(whole), telling))
        if tag in CONTENT_TAGS and not whole & FURNITURE:
            for at in reversed(self.open):
                if self.nodes[at].frames:  # and so all above
                    break
                self.nodes[at].frames = True
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.tags[tag] += 1
            self.hidden += tag in HIDDEN
            self.links += tag == "a"

    def _close_to(self, depth: int) -> None:
        for at in self.open[depth:]:
            tag = self.nodes[at].tag
            self.tags[tag] -= 1
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[depth:]

    def _nearest(self, tags: set[str], limits: set[str]) -> int | None:
        if not any(self.tags[tag] for tag in tags):
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in tags:
                return depth
            if tag in limits or tag in ("table", "article", "section", "div", "body") and tag not in tags:
                return None
        return None

    def handle_starttag(self, tag: str, attributes) -> None:
        if tag in ENDS_PARAGRAPH and not self.hidden:
            if (depth := self._nearest({"p"}, set())) is not None:
                self._close_to(depth)
        if tag in CLOSES and (depth := self._nearest(CLOSES[tag], LIMITS.get(tag, {"table"}))) is not None:
            self._close_to(depth)
        if tag == "body" and self.hidden:  # a head that was never closed
            if (depth := self._nearest({"head"}, set())) is not None:
                self._close_to(depth)
        if tag in BLOCKS:
            self._border()
        self._start(tag, attributes)
        if tag in VOID and tag in BLOCKS:
            self._border()

    def handle_startendtag(self, tag: str, attributes) -> None:
        self.handle_starttag(tag, attributes)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if self.tags[tag]:
            depth = len(self.open) - 1
            while self.nodes[self.open[depth]].tag != tag:
                depth -= 1
            self._close_to(depth)
        if tag in BLOCKS:
            self._border()

    def _border(self) -> None:
        if self.pieces and self.pieces[-1][1] != "\n":
            self.pieces.append((-1, "\n"))

    def handle_data(self, data: str) -> None:
        if self.hidden or not data:
            return
        self.pieces.append((self.open[-1], data))
        length = len(data.strip())
        if length:  # summed upwards when all is read
            node = self.nodes[self.open[-1]]
            node.text += length
            node.linked += length if self.links else 0
            node.own += length
            node.stops += len(STOP.findall(data))


def _says(node: Node) -> str:
    """What a node's own tag and words tell: furniture, content or nothing. What frames an article is not furniture."""
    if node.tag in CONTENT_TAGS:
        return "furniture" if node.whole & FURNITURE else "content"
    if node.tag in FURNITURE_TAGS or node.telling:
        return "" if node.frames else "furniture"
    return "content" if CONTENT & node.words and not AMBIGUOUS & node.words else ""


def _prose(node: Node) -> list[str]:
    """What a node's own text looks like, by its sentences and length."""
    return [f"prose:{('line' if node.own > 24 else 'short', 'one', 'more')[min(2, node.stops)]}"] if node.own else []


def parsed(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = tree.nodes
    for node in reversed(nodes[1:]):  # children stand after their parents
        nodes[node.parent].text += node.text
        nodes[node.parent].linked += node.linked
        node.sentences += node.stops
        nodes[node.parent].sentences += node.sentences
    kin = Counter((node.parent, node.tag) for node in nodes)
    around: list[frozenset[str]] = []
    for at, node in enumerate(nodes):
        share = node.linked / node.text if node.text else 0.0
        if AMBIGUOUS & node.words and not CONTENT_TAGS & {node.tag}:
            node.telling = node.telling or not node.sentences or share >= 0.25
        node.within = nodes[node.parent].within if at else ""
        around.append(nodes[node.parent].whole or around[node.parent] if at else frozenset())
        if node.tag in FRAME:
            node.features = _prose(node)
            continue
        node.within = _says(node) or node.within
        node.features = [f"tag:{node.tag}", f"links:{min(3, int(share * 4))}", f"kin:{node.tag}:{min(3, kin[node.parent, node.tag].bit_length())}"]
        node.features += _prose(node)
        # A word of the lexicon says what it says at full weight where it is telling; beside a content word an ambiguous one says nothing.
        mixed = CONTENT & node.words and AMBIGUOUS & node.words and not node.telling
        node.features += [
            f"hint:{word}" if word in AMBIGUOUS and not node.telling else f"word:{word}"
            for word in node.words if not (mixed and (word in CONTENT or word in AMBIGUOUS))
        ]
        node.features += [f"class:{one}" for one in node.whole] + [f"under:{one}" for one in around[at]]
        if node.within:
            node.features.append(f"within:{node.within}")
    return tree


def marked_content(tree: _Tree) -> list[int | None] | None:
    """The labels that tags give: content inside article or main and outside furniture tags there; None without such tags.

    Tags do not say what elements with a telling class inside an article are: they have no label.
    """
    labels: list[int | None] = []
    any_content = False
    for at, node in enumerate(tree.nodes):
        label = labels[node.parent] if at else 0
        if node.tag in CONTENT_TAGS and not node.telling:
            label, any_content = 1, True
        elif node.tag in FURNITURE_TAGS and not node.frames:
            label = 0
        elif label == 1 and node.telling and not node.frames:
            label = None
        labels.append(label)
    return labels if any_content else None


def counted(trees) -> Counter:
    """Counts (name, label) over labelled nodes: of features, of nodes (``nodes``), of pages (``pages``, 1), of edges (``edge:`` and the parent's label)."""
    counts: Counter = Counter()
    for tree in trees:
        labels = marked_content(tree)
        if labels is None:
            continue
        counts["pages", 1] += 1
        for node, label in zip(tree.nodes, labels):
            if label is None or node.tag in FRAME or node.frames:
                continue
            counts["nodes", label] += 1
            for feature in node.features:
                if not feature.startswith("within:"):  # the lexicon's own word
                    counts[feature, label] += 1
            above = tree.nodes[node.parent]
            if labels[node.parent] is not None and above.tag not in FRAME and not above.frames:
                counts[f"edge:{labels[node.parent]}", label] += 1
    return counts


_NEUTRAL = ((0.0, 0.0), (0.0, 0.0))


@dataclass
class Model:
    """Log potentials: of features by label, of a child's label by its parent's; what frames a page says nothing of its children."""

    features: dict[str, tuple[float, float]]
    edges: tuple[tuple[float, float], tuple[float, float]]

    def edge(self, parent: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        return _NEUTRAL if parent.tag in FRAME else self.edges

    def potential(self, node: Node) -> tuple[float, float]:
        no = yes = 0.0
        for feature in node.features:
            if feature in self.features:
                a, b = self.features[feature]
                no, yes = no + a, yes + b
        return no, yes


def _priors() -> dict[str, float]:
    """Prior log odds of content."""
    return {
        **{f"word:{word}": -TELLING for word in FURNITURE}, **{f"word:{word}": TELLING for word in CONTENT},
        **{f"tag:{tag}": -TELLING for tag in FURNITURE_TAGS}, **{f"tag:{tag}": TELLING for tag in CONTENT_TAGS},
        **{f"hint:{word}": -HINT for word in AMBIGUOUS}, "within:furniture": -INSIDE, "within:content": TELLING, **PLAIN_PRIORS,
    }


def model_from(counts: dict[tuple[str, int], float]) -> Model:
    """Potentials from counts as ``counted`` gives them: learnt log odds, by how often a feature was seen, added to the prior's."""
    total = [counts.get(("nodes", label), 0.0) for label in (0, 1)]
    odds = _priors()
    for name in {name for name, _ in counts}:
        kind = name.partition(":")[0]
        if kind in ("pages", "nodes", "edge"):
            continue
        seen = [counts.get((name, label), 0.0) for label in (0, 1)]
        place = kind in ("word", "hint", "class", "under")
        rate = []
        for n, nodes in zip(seen, total):
            more = 0.5 + (PLACE * counts.get(("pages", 1), 0.0) if place else COMMON * nodes)
            rate.append((n + more) / (nodes + 2 * more))
        odds[name] = odds.get(name, 0.0) + math.log(rate[1] / rate[0]) * sum(seen) / (sum(seen) + BELIEF)
    table = []
    for above in (0, 1):
        row = [counts.get((f"edge:{above}", below), 0.0) + EDGES[above][below] for below in (0, 1)]
        table.append(tuple(math.log(n / sum(row)) for n in row))
    return Model({name: (-w / 2, w / 2) for name, w in odds.items()}, tuple(table))


def marginals(tree: _Tree, model: Model) -> list[float]:
    """Probability that each node is content: sum-product, upward in reverse document order, downward in document order."""
    nodes = tree.nodes
    up = [list(model.potential(node)) for node in nodes]
    message: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)

    def plus(a: float, b: float) -> float:
        top = a if a > b else b
        return top + math.log(math.exp(a - top) + math.exp(b - top))

    for at in range(len(nodes) - 1, 0, -1):
        no, yes = up[at]
        edge = model.edge(nodes[nodes[at].parent])
        sent = plus(edge[0][0] + no, edge[0][1] + yes), plus(edge[1][0] + no, edge[1][1] + yes)
        message[at] = sent
        above = up[nodes[at].parent]
        above[0] += sent[0]
        above[1] += sent[1]
    belief: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
    belief[0] = up[0][0], up[0][1]
    out = [0.0] * len(nodes)
    for at, node in enumerate(nodes):
        if at:
            above, sent, edge = belief[node.parent], message[at], model.edge(nodes[node.parent])
            no, yes = above[0] - sent[0], above[1] - sent[1]  # the parent without what this node told it
            down = plus(edge[0][0] + no, edge[1][0] + yes), plus(edge[0][1] + no, edge[1][1] + yes)
            belief[at] = up[at][0] + down[0], up[at][1] + down[1]
        no, yes = belief[at]
        out[at] = 1.0 / (1.0 + math.exp(min(700.0, no - yes)))
    return out


def main_text(html: str | None, model: Model) -> str:
    tree = parsed(html)
    likely = marginals(tree, model)
    kept = "".join(text if at < 0 or likely[at] > 0.5 else " " if not text.strip() else "\n" for at, text in tree.pieces)
    return " ".join(kept.split())


def train(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", limit: int = TRAINING_PAGES) -> Model:
    """Count potentials over a bounded sample of pages: those with the smallest hash of id and html, about ``limit``.

    The sample's counts are summed in Spark; what reaches the driver is one row per feature, of at most
    ``limit`` pages' features.
    """
    bounded_batches(pages.sparkSession)
    sample = sampled(pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")), limit, "id", "html")

    def run(batches):
        for batch in batches:
            counts = counted(map(parsed, batch.column("html").to_pylist()))
            yield pa.RecordBatch.from_pylist(
                [{"feature": f, "label": k, "n": n} for (f, k), n in counts.items()],
                pa.schema({"feature": pa.string(), "label": pa.int32(), "n": pa.int64()}),
            )

    rows = sample.select("html").mapInArrow(run, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect()
    return model_from({(r["feature"], r["label"]): float(r["n"]) for r in rows})


def extract(pages: DataFrame, model: Model | None = None, limit: int = TRAINING_PAGES) -> DataFrame:
    """Main text of every page (page_id, url, html): page_id, url, text.

    Missing and empty html, and pages without content, give an empty text; markup that is cut short or not closed is read as
    far as it goes; long pages are read whole; repeated rows stay repeated; an empty table gives no rows (its model is the
    prior alone); other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    model = model or train(pages, limit=limit)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(html, model) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {kind}, url string, text string")
