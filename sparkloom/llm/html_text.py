"""Main text of web pages by composite text density.

For every node of a page's tree, characters per tag are weighted down by the
share of its text that lies in links. The node whose children's densities add up to the most
is the core. It is kept with the nearest article, else main, around it, or else reaches up
while what the parent adds is not link lists. The least density on the path from the core to the
body is the threshold for the rest of the page: every other subtree and run of text that reaches
it and is not link lists is kept too, in page order.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader
comments are left out by their elements, roles and names. A role, a name or a form does not
leave out what holds the only article or main, or most of the page's text outside links.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe svg canvas object embed audio video dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body td th blockquote".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split()) | INLINE
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer comment comments disqus replies share sharing social newsletter subscribe signup login related widget toolbar pagination".split()
)
COMMENTS = frozenset("comment comments disqus replies".split())
_CUT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
#: What is markup where it stands: comments, which run to the page's end if nothing closes them; declarations, marked sections, instructions and ends of nothing, which end
#: at the next >; and whole tags, in whose quoted values nothing is markup. Every part takes what it can and gives nothing back, so the time is in proportion to the page.
_MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-z]))[^>]*+>?|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*+)(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""", re.S | re.I)
#: Elements that hold no markup but their own end; without one, the first two run to the page's end.
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "comments", "partly", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False):
        self.tag, self.parent, self.parts, self.dropped = tag, parent, [], dropped
        self.named = self.comments = self.partly = False
        self.inside = None if parent is None else parent if parent.tag in ("article", "main") else parent.inside  # the nearest article or main above


class _Tree(HTMLParser):
    """Builds the tree, closing what HTML lets authors leave open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open: Counter = Counter()  # tags from the root to where the parser is

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body" and self.at.tag != "body":
                self._open(tag, attrs)
            return
        if self.at.tag == "head" and tag not in ("title", "style", "script", "meta", "link", "base", "noscript", "template"):
            self._close("head")
        if tag in CLOSES_P:
            self._close_near({"p"})
        if tag in CLOSES_OWN:
            self._close_near(CLOSES_OWN[tag])
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.parts.append(Node(tag, self.at))
            return
        self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _open(self, tag, attrs):
        node = Node(tag, self.at, unwanted(tag, attrs, self.at))
        node.named = not node.dropped and named(tag, attrs)
        words = [{w.lower() for w in _CUT.split(v) if w} for n, vs in attrs if n in ("class", "id") and vs for v in vs.split()]
        node.comments = node.named and any(w & COMMENTS for w in words)
        node.partly = node.named and tag != "form" and not any(n == "role" for n, _ in attrs) and not any(w <= NAMES for w in words)
        self.at.parts.append(node)
        self.at = node
        self.open[tag] += 1

    def _leave(self, node):
        """Close everything up to a node and the node itself."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            return
        if tag == "p":
            self._close_near({"p"})
        else:
            self._close(tag)

    def _close(self, tag):
        node = self.at
        while self.open[tag] and node.parent is not None:
            if node.tag == tag:
                return self._leave(node)
            node = node.parent

    def _close_near(self, tags):
        node = self.at
        while any(self.open[t] for t in tags) and node.parent is not None and node.tag not in SCOPE - tags:
            if node.tag in tags:
                return self._leave(node)
            node = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)

    def unknown_decl(self, data):
        pass


def unwanted(tag: str, attrs, parent: Node | None) -> bool:
    """Whether an element is left out with all it holds, whatever that is."""
    if tag in DROPPED and tag != "form":
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if tag == "header" and (parent is None or parent.inside is None and parent.tag not in ("article", "main")):
        return True
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def named(tag: str, attrs) -> bool:
    """Whether an element is left out by its role or name, or as a form, unless it holds the page's text."""
    if tag in ("html", "body", "main", "article"):
        return False
    roles = (v.lower() in ROLES for n, v in attrs if n == "role" and v)
    return tag == "form" or any(roles) or any(w.lower() in NAMES for n, v in attrs if n in ("class", "id") and v for w in _CUT.split(v))


def drop_named(root: Node) -> None:
    """Leave out named elements, but for those that hold the only article or main, or most of the page's text outside links.

    Comments stay out however long they are, if an article or main stands elsewhere.
    Inside an article or main, a name of which only a part tells (related-work, menu-history) leaves out only
    what reads unlike the article: link lists, and text that is less than half as dense.
    """
    order = weigh(root)
    if not any(n.named for n in order):
        return
    under: dict[Node, tuple] = {}  # whether each node lies in a named element, and in comments
    for node in order:
        named_above, comments_above = under.get(node.parent, (False, False))
        under[node] = named_above or node.named, comments_above or node.comments
    plain = lambda n: n.chars - n.link_chars
    texts = [n for n in order if n.tag in ("article", "main")]
    outside, elsewhere = any(not under[n][0] for n in texts), any(not under[n][1] for n in texts)
    holds: set[Node] = set()
    for node in texts:
        while node is not None and node not in holds:
            holds.add(node)
            node = node.parent
    for node in order:
        if node.named:
            most = plain(node) * 2 > plain(root)
            around = node.inside
            like = node.partly and around is not None and not node.comments and node.link_chars * 3 <= node.chars and node.chars * max(1, around.tags) * 2 >= around.chars * max(1, node.tags)
            node.dropped = node.comments and elsewhere or not (most or like or node in holds and not outside)


def weigh(root: Node) -> list[Node]:
    """All kept nodes, parents first, with their densities and the sums of their children's."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped)
    for node in reversed(order):
        node.chars = sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, Node) and not p.dropped:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.chars if p.tag == "a" else p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = _density(node, share)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.dropped)
    return order


def _density(node: Node, body_share: float) -> float:
    """Characters per tag, times the logarithm of the inverse link shares, to a base that grows with link text."""
    if not node.chars:
        return 0.0
    c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
    base = math.log(c / max(1, c - node.link_chars) * node.link_chars + body_share * c + math.e)
    return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.000001)) if base > 1 else math.log(max(1.0, c / lc * t / lt)))


def core(root: Node) -> Node:
    """The tree, cut down to the core and every other subtree at or above the least density on the core's path."""
    order = weigh(root)
    best = max(order, key=lambda n: n.total)
    if not best.total:
        return root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least, share = min(n.density for n in path), root.link_chars / max(1, root.chars)
    above, best = set(path), _around(path)
    stack = [root] if best is not root else []
    while stack:
        node = stack.pop()
        kept, run = [], []
        for part in [*node.parts, None]:
            if isinstance(part, str) or part is not None and part.tag in INLINE and part not in above:
                run.append(part)
                continue
            if _kept(_run(run), least, share):
                kept += run
            run = []
            if part is None or part.dropped:
                continue
            kept.append(part)
            if part is not best and (part in above or part.density < least or part.link_chars * 3 > part.chars):
                stack.append(part)
        node.parts = kept
    return root


def _around(path: list[Node]) -> Node:
    """What is kept whole around the core: path[0]."""
    best = path[0]
    for tag in ("article", "main"):
        for node in path:
            if node.tag == tag:
                return node
    for parent in path[1:]:
        added, links = parent.chars - best.chars, parent.link_chars - best.link_chars
        if parent.tag in ("body", "html") and best.tag not in FLOW or added and links * 3 > added:
            break
        best = parent
    return best


def _run(parts: list) -> Node:
    """Text and inline elements between blocks, as a weighed node of their own."""
    node = Node("p", None)
    node.parts = parts
    weigh(node)
    return node


def _kept(node: Node, least: float, share: float) -> bool:
    return bool(node.chars) and node.link_chars * 3 <= node.chars and _density(node, share) >= least


def visible(node: Node) -> str:
    """The text of a subtree: blocks in page order, white space inside and between them as one space."""
    blocks, run, stack = [], [], [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            run.append(part)
        elif part is None or part.tag in ("br", "hr"):
            blocks.append("".join(run))
            run = []
        elif not part.dropped:
            if part.tag in INLINE:
                stack.extend(reversed(part.parts))
            else:
                stack += [None, *reversed(part.parts), None]
    blocks.append("".join(run))
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def without_comments(html: str) -> str:
    """A page without comments, declarations and instructions, and without elements that hold no markup, which are left out with all they hold."""
    out, kept, at, endless = [], 0, 0, set()
    while found := _MARKUP.search(html, at):
        at, tag = found.end(), (found["tag"] or "").lower()
        if tag in RAW and not found["end"] and not (tag in endless):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            if close is None and tag not in RAW[:2]:
                endless.add(tag)  # looked for once
            else:
                out.append(html[kept : found.start()])
                kept = at = len(html) if close is None else close.end()
        elif not tag:
            out.append(html[kept : found.start()])
            kept = at
    return "".join([*out, html[kept:]])


def extract(html: str) -> str:
    """The main text of one page; empty if it has none."""
    tree = _Tree()
    html = without_comments(html)
    try:
        tree.feed(html)
        if re.match(r"</?[A-Za-z]", tree.rawdata):  # a tag that the page's end cuts off is no text
            tree.rawdata = ""
        tree.close()
    except (AssertionError, ValueError):  # the parser gave up on broken markup; what it has built stands
        pass
    drop_named(tree.root)
    return visible(core(tree.root))


def main_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of each whole page in ``text``, in place of any column of that name.

    Null and empty pages, and pages without text, have an empty text. Broken marked sections end at the next
    angle bracket, comments that nothing closes at the page's end; inside quoted values and raw elements none begins. Other columns pass unchanged; repeated rows stay repeated.
    """

    def make():
        def work(batch):
            return [pa.array([extract(h or "") for h in batch.column(batch.schema.names.index(html)).to_pylist()], pa.string())]

        return work

    return append_columns(df, T.StructType([T.StructField(text, T.StringType(), False)]), make, html)
