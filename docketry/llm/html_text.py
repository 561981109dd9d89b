"""Main text of HTML pages by composite text density.

A page becomes a tree of elements, of which only what is no text by its markup is taken out: scripts,
styles, controls, hidden parts. Each node has a density: its characters for each tag below it, scaled
down by the share of its characters and tags that are links. The node whose children's densities have
the largest sum is the core of the article. The threshold is the smallest density on the path from the
core to the body. Going up that path, the parts beside it are marked by their density: what holds the
threshold and isn't made of links belongs to the article, the rest doesn't, and where nothing more
belongs the article ends.

Density can't tell a notice or a reader's comment from a paragraph. So tags and names raise a doubt:
menus, adverts, notices and comments by their names don't add to the sums, aren't the core, and of
what density has taken they are left out. What a page is made of is taken whatever its name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    # quotes count after an equals sign only, as in HTML
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:"[^"]*"|'[^']*')|[^>=]|=(?!\s*["']))*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL,
)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul video audio".split()
)
#: An opening tag closes these open ones, up to the elements in WITHIN.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
WITHIN = frozenset("ul ol dl table select body article section div".split())
SCOPE = WITHIN | CLOSES.keys()
BARRIER = BLOCK - {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: No text of any part by its markup.
OUT_TAGS = frozenset("head script style noscript template textarea title iframe noframes button select input svg canvas object map audio video".split())
#: Parts that are no article by their markup, as a rule.
DOUBT_TAGS = frozenset("nav footer aside dialog menu fieldset".split())
DOUBT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: A name with one of these words raises a doubt,
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos cookie cookies consent gdpr "
    "popup popover modal newsletter subscribe signup login paywall nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer "
    "masthead topbar toolbar pagination pager adbox adslot adunit adspace adcontainer adwrapper adsbygoogle".split()
)
#: one with these words if it has no others but LAYOUT: a share bar does, a share price does not.
PART_WORDS = frozenset(
    "promotion banner notice notices alert alerts overlay subscription menu menus aside asides widget widgets share sharing social related "
    "recommended recommendations skip disclaimer announcement announcements".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons center column container content entry field fixed form group header icon icons inner item items left "
    "line link links list main message module more outer page panel part posts row section site small sticky strip text this title to tools top right wrap wrapper".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist commentbox disqus guestbook".split())
#: Readers' replies, if something below looks like them; a paper has a discussion too.
REPLY_WORDS = frozenset("respond response responses reply replies discussion".split())
REPLY_SIGNS = COMMENT_WORDS | frozenset("author avatar vcard says byline commenter username user reader timestamp reply".split())
ROOTS = frozenset(("article", "main"))
#: Parts of running text, which a core's parent may hold beside it whatever their length.
FLOW = frozenset("p blockquote pre ul ol dl table figure figcaption h1 h2 h3 h4 h5 h6 header hr br".split())
#: Share of links among the characters of a part, up to which it may belong to an article.
LINKED = 0.3
#: A part of the body beside the core has this share of the core's sum of densities at least, in some part of its own.
BESIDE = 0.2


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "hints", "out", "doubt", "named", "root", "heading", "chars", "tags", "linked", "links", "density", "total", "peak")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.hints = tag, attrs, parent, [], None
        self.out = self.doubt = self.named = self.root = self.heading = False
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.total = self.peak = 0.0


class Open:
    """The open elements, with the places of those that are looked for, so that none is looked for one by one."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Closes all from place at on; the root stays."""
        while len(self.stack) > max(at, 1):
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if not self.places[tag]:
                del self.places[tag]

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((p[-1] for t, p in self.places.items() if t in tags), default=0)

    def first_after(self, tags, at: int) -> int:
        """The place of the outermost one after a place, or 0."""
        found = [p[k] for t, p in self.places.items() if t in tags and (k := bisect_right(p, at)) < len(p)]
        return min(found, default=0)


def tree(html: str) -> Node:
    """The element tree; kids are nodes and strings. Unclosed and misplaced tags do no harm."""
    root = Node("html", "", None)
    up, pos, n, body = Open(root), 0, len(html), False
    while pos < n:
        m = TOKEN.search(html, pos)
        if m is None:
            up.stack[-1].kids.append(html[pos:])
            break
        if m.start() > pos:
            up.stack[-1].kids.append(html[pos : m.start()])
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            at = up.last((tag,))
            if at and (tag in BLOCK or at > up.last(BARRIER)):  # an inline end tag reaches no further than its block
                up.cut(at)
            continue
        if tag == "html" or tag == "body" and body:
            continue
        if tag == "body":
            up.cut(1)
            body = True
        elif tag in BLOCK and tag != "br":
            p = up.last(("p",))
            if p > up.last(SCOPE):
                up.cut(p)
            if shut := CLOSES.get(tag):
                if at := up.first_after(shut, up.last(WITHIN)):
                    up.cut(at)
        node = Node(tag, m["attrs"] or "", up.stack[-1])
        up.stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            up.push(node)
    return root


def words_of(name: str) -> list[str]:
    """The words of a class or an id."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in (x.rstrip("0123456789") for x in re.split(r"[^a-z0-9]+", name.lower())) if w]


def hints(node: Node) -> tuple[list[list[str]], str, bool]:
    """Words of each class and of the id, the role, and whether the element is hidden."""
    if not node.attrs.strip():
        return [], "", False
    names, role, hidden = [], "", False
    for name, a, b, c in ATTR.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names += [words_of(x) for x in value.split()]
        elif name == "role":
            role = value.lower().strip()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
    return names, role, hidden


def named_out(names: list[list[str]], signs: bool) -> bool:
    """Whether a name raises a doubt; signs: something below looks like readers' replies."""
    for words in names:
        if any(w in OUT_WORDS or w in COMMENT_WORDS or signs and w in REPLY_WORDS for w in words):
            return True
        if any(w in PART_WORDS for w in words) and all(w in PART_WORDS or w in LAYOUT for w in words):
            return True
    return False


def in_order(root: Node, all_parts: bool = False) -> list[Node]:
    """The elements of a subtree, parents first and in page order; those that are out only if all are wanted."""
    order, rest = [], [root]
    while rest:
        node = rest.pop()
        order.append(node)
        rest += [k for k in reversed(node.kids) if isinstance(k, Node) and (all_parts or not k.out)]
    return order


def strip(root: Node) -> list[Node]:
    """Marks what is no text as out, and what raises a doubt; the outermost parts in doubt by their name alone."""
    order, signs, sizes = in_order(root, all_parts=True), {}, {}
    for node in reversed(order):
        node.hints = names, role, hidden = hints(node)
        below = [k for k in node.kids if isinstance(k, Node)]
        size = sum(len(k) if not isinstance(k, Node) else sizes[id(k)] for k in node.kids)
        sizes[id(node)] = 0 if node.tag in OUT_TAGS else size
        signs[id(node)] = any(signs[id(k)] or k.tag in ("form", "textarea") or any(w in REPLY_SIGNS for x in k.hints[0] for w in x) for k in below)
        top = node.parent is None or node.tag == "body"
        node.named = not top and named_out(names, signs[id(node)])
        node.out = not top and (node.tag in OUT_TAGS or hidden)
        node.doubt = not top and (node.tag in DOUBT_TAGS or role in DOUBT_ROLES or node.tag in ("ul", "ol") and menu(node))
        if node.parent is not None and not node.out and not node.doubt:  # whether there is an article, or a heading, below
            up = node.parent
            up.root |= node.root or node.tag in ROOTS and not node.named
            up.heading |= node.heading or node.tag in HEADINGS
    named, rest = [], [(root, False)]
    while rest:
        node, inside = rest.pop()
        names = node.hints[0]
        if node.tag == "form" and not node.doubt:  # a form around the page is one of its wrappers
            node.doubt = not node.root and 2 * sizes[id(node)] < sizes[id(root)]
        if node.named and not node.doubt:
            # a wrapper named after its layout isn't one of the parts
            wraps = (node.tag in ROOTS or node.root) and not any(w in COMMENT_WORDS for x in names for w in x)
            node.doubt = not wraps
        elif not node.doubt and (node.tag == "header" or ["header"] in names and node.tag not in HEADINGS) and node.parent is not None:
            node.doubt = not node.root and not (inside and node.heading)  # an article's own head holds its heading
        if node.out:
            continue
        if node.doubt:
            named += [node] if node.named else []
        else:
            inside = inside or node.tag in ROOTS
            rest += [(k, inside) for k in node.kids if isinstance(k, Node)]
    return named


def menu(node: Node) -> bool:
    """Whether a list holds three links or more and no other text."""
    links = 0
    rest: list = [*node.kids]
    while rest:
        k = rest.pop()
        if not isinstance(k, Node):
            if k.strip():
                return False
        elif k.tag == "a":
            links += 1
        elif not k.out:
            rest += k.kids
    return links >= 3


def measure(root: Node) -> list[Node]:
    """Sets counts, densities and sums of densities; the nodes that are kept, in page order."""
    order = in_order(root)
    for node in order:
        node.chars = node.tags = node.linked = node.links = 0
        node.density = node.total = node.peak = 0.0
    linked = {id(root): False}
    for node in order:
        own = linked[id(node)] or node.tag == "a"
        for k in node.kids:
            if isinstance(k, Node):
                linked[id(k)] = own
            else:
                n = len("".join(unescape(k).split()))
                node.chars += n
                node.linked += n * own
    for node in reversed(order):
        if (up := node.parent) is not None and node is not root:
            up.chars += node.chars
            up.linked += node.linked
            up.tags += node.tags + 1
            up.links += node.links + (node.tag == "a")
    share = root.linked / max(1, root.chars)
    for node in order:
        if node.chars:
            tags, links_in, links = max(1, node.tags), max(1, node.linked), max(1, node.links)
            plain = node.chars / links_in * tags / links
            base = math.log(node.chars / max(1, node.chars - node.linked) * node.linked + share * node.chars + math.e)
            node.density = node.chars / tags * math.log(max(plain, 1.0001)) / max(math.log(base), 1.0)
        if node.parent is not None and node is not root and not node.doubt:
            node.parent.total += node.density
    for node in reversed(order):
        node.peak = max(node.peak, weight(node))
        if node.parent is not None and node is not root and not node.doubt:
            node.parent.peak = max(node.parent.peak, node.peak)
    return order


def weight(node: Node) -> float:
    """The sum of densities below a node, or its own where it holds its text itself."""
    return node.total or node.density * 0.999


def believed(root: Node) -> list[Node]:
    """The elements of a subtree that are in no part in doubt, parents first."""
    order, rest = [], [root]
    while rest:
        node = rest.pop()
        order.append(node)
        rest += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.out and not k.doubt]
    return order


def core(root: Node) -> Node | None:
    """The root of the article of a measured page; parts below it that don't belong to it are marked as out."""
    full = [x for x in believed(root) if x.chars]
    best = max(full, key=weight, default=None)
    if best is None or not weight(best):
        return None
    path = [best]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)

    def dense(x: Node) -> bool:
        return x.density >= threshold and x.linked <= LINKED * x.chars

    taken, outermost = best, max((k for k, x in enumerate(path) if x.tag in ROOTS), default=0)
    for k, up in enumerate(path[1:], 1):
        inside = k <= outermost
        top = up.tag in ("body", "html")
        beside = [x for x in up.kids if isinstance(x, Node) and not x.out and x.chars and x is not path[k - 1]]
        if inside:  # all of an article belongs to it, but for parts of links
            kept = [x for x in beside if x.linked <= LINKED * x.chars or x.density >= threshold]
        elif top:
            kept = [x for x in beside if dense(x) and x.peak >= BESIDE * best.peak]
        else:
            kept = [x for x in beside if dense(x) or x.tag in FLOW and x.linked <= LINKED * x.chars]
        kept = [x for x in kept if not x.doubt]
        loose = any(isinstance(x, str) and x.strip() for x in up.kids) and not top
        if top and not kept:
            break
        if not top and not kept and not loose and any(not x.doubt for x in beside):
            break
        for x in beside:
            x.out = x not in kept and not (top and x.tag == "h1" and up.kids.index(x) < up.kids.index(path[k - 1]))
        if top:  # text between the parts of a body is no part of an article
            up.kids = [x for x in up.kids if isinstance(x, Node)]
        taken = up
        if up.tag == "article":
            break
    for x in in_order(taken):
        x.out |= x.doubt and x is not taken
    return taken


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below a node, in page order, white space squeezed."""
    part: list[str] = []
    rest: list = [node]
    while rest:
        x = rest.pop()
        if x is None:  # a block's edge
            text = " ".join(unescape("".join(part)).split())
            part = []
            if text:
                yield text
        elif not isinstance(x, Node):
            part.append(x)
        elif not x.out:
            edge = [None] if x.tag in BLOCK else []
            rest += edge + x.kids[::-1] + edge
    text = " ".join(unescape("".join(part)).split())
    if text:
        yield text


def article(root: Node) -> Node | None:
    """The article of a page; what is out below it doesn't belong to it."""
    named = strip(root)
    order = believed(root)
    measure(root)
    own = max((weight(x) for x in order if x.chars), default=0.0)
    roots = any(x.tag in ROOTS and x.chars for x in order)
    # a part in doubt by its name alone may be what the page is made of: an article where there is no other, or most of the text
    comments = [x for x in named if any(w in COMMENT_WORDS | REPLY_WORDS for words in x.hints[0] for w in words)]
    heavy = [x for x in named if x.tag in ROOTS and not roots or x not in comments and not roots and BESIDE * x.peak > own]
    if not heavy and not own:
        heavy = named
    if heavy:
        best = max(heavy, key=lambda x: x.peak)
        while best.parent is not None:  # what is around it can't be in doubt either
            best.doubt = False
            best = best.parent
        measure(root)
    return core(root)


def main_text(html: str | None) -> str:
    """The blocks of the article, one a line; empty if the page has no text."""
    if not html:
        return ""
    node = article(tree(html))
    if node is None:
        return ""
    found = list(blocks(node))
    before = []
    while node.parent is not None and node.tag not in ROOTS:  # headings that stand before a core without an article around it
        kids = node.parent.kids
        for k in kids[: next(i for i, x in enumerate(kids) if x is node)][::-1]:
            if isinstance(k, Node) and not k.out and k.tag == "h1":
                before = [*blocks(k), *before]
        node = node.parent
    return "\n".join(before + found)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages: the main text of the whole html.

    Null and empty html, and pages without any text, give an empty text. Repeated rows come out
    repeated, null ids and urls stay null; other columns are ignored. Character references are
    decoded, white space inside a block is one space, and blocks are joined by one line end. The work
    is linear in the html, however deep its elements lie.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h if isinstance(h, str) else None) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(made, "page_id long, url string, text string")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
