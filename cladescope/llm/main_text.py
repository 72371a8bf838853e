"""Main text of web pages by tree scoring.

A page is parsed to a tree without the parts that never are the article. Every
paragraph earns points for its length and commas, discounted by the share of its
text inside links, and passes them to its nearest ancestors: all to the parent,
half to the next, and less above. The best container stands for the article (the nearest
``article`` or ``main`` above it, if there is one); siblings that score like it
or look like its paragraphs are kept with it.

Pages are independent: one pass, no shuffle, memory bounded by one batch and one
page; pages are never cut, and the work grows with a page's length, not with its depth.

Defined cases: a null or empty html gives the empty text; broken or unclosed
markup is read as far as it goes (tags end as in browsers, but a quote that is
never closed is an ordinary character); a page without a scored paragraph gives the
text of its article, main or body as it is left after removal; other columns are
ignored; repeated rows give a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.llm.common import lean

# HTML's elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
REMOVED = frozenset("head script style noscript template title nav aside header footer form button select option textarea input iframe object embed svg canvas audio video map dialog menu fieldset label xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption div section article main body".split())
#: Starting one of these ends an open element of the kinds after it, up to the limits.
CLOSES = {x: frozenset(["p"]) for x in BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}} | {
    "li": frozenset(["li", "p"]),
    "dd": frozenset(["dd", "dt", "p"]),
    "dt": frozenset(["dd", "dt", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
LIMITS = {"li": frozenset(["ul", "ol", "menu"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
SCOPE = frozenset("table td th button object article section div body html".split())

# Words in class, id or role that mark what isn't the article, those that
# mark it however else it is named, and those that remove it in any case.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup signin login share sharing social sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead header topbar toolbar pagination pager related recommended recommendation widget search searchbox contentinfo complementary dialog skip hidden".split()
)
LIKELY = frozenset("article content main body post entry story text page container wrapper".split())
NEVER = frozenset("comment comments commentlist disqus replies reply respond reader-comments cookie cookies advert advertisement".split())
# Words that only say which part of such an element a name means; with others beside, as in side-effects, a name means something else.
PART = frozenset("area bar block body bottom box button buttons center column container content float fixed form group header icon inner item items left link links list main outer panel row section slot sticky top unit wrap wrapper right site page global primary secondary".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# A tag ends as in browsers: only a value may hold the sign, and only in quotes that follow the equals sign and are closed.
_TAG = r"<([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)=?(?:>|\Z)"
_TOKEN = re.compile(r"<!--(?>>|->|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[a-zA-Z][^>]*+(?:>|\Z)|" + _TAG)
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?>\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
#: Least characters of a paragraph that scores, most points for its length, and the share of the best score that keeps a sibling.
LEAST_TEXT, MOST_POINTS, SIBLING = 25, 3.0, 0.2
#: Ancestors that a paragraph's points reach; least links and most characters of one in a menu, and the least share of its text in links.
LEVELS, MENU_LINKS, MENU_TEXT, MENU_DENSITY = 6, 3, 24, 0.9


class Node:
    __slots__ = ("tag", "names", "parent", "parts", "score", "hidden")

    def __init__(self, tag: str, names: frozenset[str], hidden: bool, parent: "Node | None"):
        self.tag, self.names, self.parent, self.hidden = tag, names, parent, hidden
        self.parts: list[Node | str] = []
        self.score = 0.0


def _attributes(text: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    if not text.strip("/ "):
        return frozenset(), False
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}
    words = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return frozenset(w for word in words.split() for w in _meaning(word)), hidden


def _meaning(name: str) -> set[str]:
    """The words of a name that tell what the element is: the name itself, or one of its words beside parts of an element."""
    if name.lower() in UNLIKELY | NEVER | LIKELY:
        return {name.lower()}
    words = {w.lower() for w in _NAME.findall(name)}
    telling = words & (UNLIKELY | NEVER)
    return words if telling and words <= UNLIKELY | NEVER | PART else words - UNLIKELY - NEVER


class _Open:
    """The open elements: the innermost, and how many of each kind, so that a tag without its like walks nowhere."""

    def __init__(self, root: Node):
        self.node, self.count = root, Counter()

    def enter(self, node: Node) -> None:
        self.node = node
        self.count[node.tag] += 1

    def leave_to(self, node: Node) -> None:
        while self.node is not node:
            self.count[self.node.tag] -= 1
            self.node = self.node.parent

    def close(self, tag: str) -> None:
        """Leave the nearest open ``tag``, if one is open."""
        if self.count[tag]:
            up = self.node
            while up.tag != tag:
                up = up.parent
            self.leave_to(up.parent)

    def make_room(self, kinds: frozenset[str], limits: frozenset[str]) -> None:
        """Leave the outermost open element of the kinds within the limits."""
        left = sum(self.count[k] for k in kinds)
        up, out = self.node, self.node
        while left and up is not None and up.tag not in limits:
            if up.tag in kinds:
                out = up.parent
                left -= 1
            up = up.parent
        self.leave_to(out)


def parse(html: str) -> Node:
    root = Node("#root", frozenset(), False, None)
    opened = _Open(root)
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            opened.node.parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            opened.node.parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[1] is None:
            if m[0].startswith("</"):
                opened.close(re.split(r"[\s/>]", m[0][2:], maxsplit=1)[0].lower())
            continue
        tag = m[1].lower()
        if kinds := CLOSES.get(tag):
            opened.make_room(kinds, LIMITS.get(tag, SCOPE))
        child = Node(tag, *_attributes(m[2]), parent=opened.node)
        opened.node.parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag not in REMOVED:
                child.parts.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID:
            opened.enter(child)
    return root


def _inside(node: Node, tag: str) -> bool:
    up = node.parent
    while up is not None and up.tag != tag:
        up = up.parent
    return up is not None


def _removed(node: Node) -> bool:
    if node.hidden or node.tag in REMOVED:
        return True
    if node.tag in ("html", "body", "main", "article", "#root"):
        # their names are states of the page, but an article inside another may be a comment
        return node.tag == "article" and bool(node.names & NEVER) and _inside(node, "article")
    if node.names & NEVER:
        return True
    return bool(node.names & UNLIKELY) and not node.names & LIKELY


def prune(root: Node) -> None:
    """Take out what is never the article."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.parts = [x for x in node.parts if isinstance(x, str) or not _removed(x)]
        stack += [x for x in node.parts if not isinstance(x, str)]


def _order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.parts) if not isinstance(x, str)]
    return out


def _measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """id(node) -> characters of its text, of those inside links, and its links."""
    sizes: dict[int, tuple[int, int, int]] = {}
    for node in reversed(_order(root)):
        total = linked = links = 0
        for x in node.parts:
            if isinstance(x, str):
                total += len(x.strip())
            else:
                a, b, c = sizes[id(x)]
                total, linked, links = total + a, linked + b, links + c
        sizes[id(node)] = (total, total, links + 1) if node.tag == "a" else (total, linked, links)
    return sizes


def _own_text(node: Node) -> str:
    """Text of the node without that of blocks inside it."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.tag not in BLOCK or x.tag == "br":
            stack += reversed(x.parts)
    return "".join(out).strip()


def score(root: Node, sizes: dict[int, tuple[int, int, int]]) -> list[Node]:
    """Score the ancestors of every paragraph; returns the scored nodes in page order."""
    nodes = _order(root)
    for node in nodes:
        if node.tag not in PARAGRAPH or node.parent is None:
            continue
        text = _own_text(node)
        if len(text) < LEAST_TEXT:
            continue
        total, linked, _ = sizes[id(node)]
        points = (1 + text.count(",") + text.count("、") + min(len(text) / 100, MOST_POINTS)) * (1 - linked / max(total, 1))
        share, up = 1.0, node.parent if node.tag not in ("div", "section", "article", "main", "body") else node
        level = 0
        while up is not None and up.tag not in ("html", "#root") and level < LEVELS:
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.parent
    for node in nodes:
        if node.score:
            total, linked, _ = sizes[id(node)]
            node.score *= 1 - linked / max(total, 1)
    return [n for n in nodes if n.score > 0]


def _semantic(node: Node) -> Node | None:
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    return None


def article_nodes(root: Node) -> list[Node]:
    """The best container, with the siblings that belong to it, in page order."""
    sizes = _measure(root)
    scored = score(root, sizes)
    if not scored:
        nodes = _order(root)
        for tag in ("article", "main", "body"):
            if found := [n for n in nodes if n.tag == tag and sizes[id(n)][0]]:
                return found[:1]
        return [root]
    best = max(scored, key=lambda n: n.score)
    if (whole := _semantic(best)) is not None:
        best = whole
    if best.parent is None or best.tag == "body":
        return [best]
    keep = []
    for x in best.parent.parts:
        if isinstance(x, str):
            continue
        total, linked, _ = sizes[id(x)]
        density = linked / max(total, 1)
        like = x.score >= max(5.0, SIBLING * best.score)
        paragraph = x.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and total and density < 0.25 and best.tag not in ("article", "main")
        if x is best or like or paragraph:
            keep.append(x)
    return keep


def _menu(node: Node, sizes: dict[int, tuple[int, int, int]]) -> bool:
    """A block inside the article that is short links and nothing else; lists of linked titles or references are longer."""
    if node.tag not in ("ul", "ol", "div", "section", "table", "dl"):
        return False
    total, linked, links = sizes[id(node)]
    return links >= MENU_LINKS and linked > MENU_DENSITY * total and linked <= MENU_TEXT * links


def text_of(nodes: list[Node]) -> str:
    """Text of the nodes: blocks in page order, white space folded, joined by one space."""
    out: list[str] = []
    for top in nodes:
        sizes = _measure(top)
        stack: list[Node | str] = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x is not top and _menu(x, sizes):
                continue
            if x.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack += reversed(x.parts)
    return " ".join("".join(out).split())


def extract(html: str) -> str:
    root = parse(html)
    prune(root)
    return text_of(article_nodes(root))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    return slim.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
