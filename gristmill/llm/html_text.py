"""Operator 7: main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template svg math object canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("html body article section div main aside nav header footer table td th ul ol dl form blockquote".split())

# elements, roles and class or id words that are never part of an article
NOT_TEXT = frozenset("head nav footer aside form menu button select dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus feedback footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion reactions replies responses share sharing sidebar signup sponsor sponsored subscribe subscription toolbar widget".split()
)
# words that say nothing of what an element holds
NEUTRAL = frozenset("area bar bottom box block container content entry form group inner item left line link links list main outer page panel reader readers right section site social thread top user users visitor wrap wrapper".split())
# containers, whose names count; headings, paragraphs and the like are what an article is made of
CONTAINERS = frozenset("div section aside ul ol dl table center fieldset details".split())
WHOLE = frozenset("html body main article".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
CUT = re.compile(r"<(?:/?[a-zA-Z][^>]*+|[!?][^>]*+)\Z")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element: its children are nodes and strings. Counts are of the subtree."""

    __slots__ = ("chars", "children", "density", "links", "link_chars", "name", "parent", "skip", "sum", "tags")

    def __init__(self, name: str, parent: Node | None, skip: bool = False):
        self.name, self.parent, self.skip, self.children = name, parent, skip, []
        self.chars = self.tags = self.links = self.link_chars = 0
        self.density = self.sum = 0.0


def furniture(value: str) -> bool:
    """Whether a class or id says that a container is page furniture: a name made of furniture words and neutral ones only.

    "comments", "cookie-notice" and "ad" are; "related-work", "with-sidebar" and "comments-on-method" are not.
    """
    for name in value.split():
        parts = WORD.findall(name)
        if any(w in NAMES for w in parts) and all(w in NAMES or w in NEUTRAL or w.isdigit() for w in parts):
            return True
    return False


def unwanted(name: str, attrs: str, inside_article: bool) -> bool:
    """True for elements that hold no article text, by element, role, visibility or, for containers, their name."""
    if name in NOT_TEXT or (name == "header" and not inside_article):
        return True
    if not attrs or name in WHOLE:
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            if name in CONTAINERS and furniture(value):
                return True
        elif (key == "role" and value in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def parse(html: str) -> Node:
    """A lenient DOM: unclosed elements end where the standard ends them; a tag cut off at the end is dropped."""
    root = Node("body", None)
    at, open_ = 0, root
    cut = CUT.search(html, max(0, html.rfind("<")))
    end = cut.start() if cut else len(html)
    while at < end:
        m = TAG.search(html, at, end)
        if m is None:
            open_.children.append(html[at:end])
            break
        if m.start() > at:
            open_.children.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            node = open_
            while node is not root and node.name != name and not (name not in BLOCKS and node.name in SCOPES):
                node = node.parent
            if node is not root and node.name == name:
                open_ = node.parent
            continue
        if name in ("html", "body"):
            while open_.name == "head":
                open_ = open_.parent
            continue
        if name in ("svg", "math") and m[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = html.find(">", close.start()) + 1 if close else end
            at = at or end
            continue
        if name in VOID:
            open_.children.append(Node(name, open_))
            continue
        closes = CLOSES.get(name, ())
        node = open_
        while node is not root:
            if node.name in closes or (node.name == "p" and name in BLOCKS):
                open_ = node.parent
                break
            if node.name in SCOPES:
                break
            node = node.parent
        inside, node = False, open_
        while node is not None and not inside:
            inside, node = node.name in ("article", "main"), node.parent
        open_.children.append(new := Node(name, open_, unwanted(name, m[3], inside)))
        open_ = new
    return root


def measure(root: Node) -> list[Node]:
    """Counts, composite densities and density sums of all nodes in play, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.skip]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            elif not c.skip:
                node.chars, node.tags = node.chars + c.chars, node.tags + c.tags + 1
                node.links, node.link_chars = node.links + c.links + (c.name == "a"), node.link_chars + c.link_chars
        if node.name == "a":
            node.link_chars = node.chars
    body = root.link_chars / max(root.chars, 1)
    for n in order:
        if n.chars:
            tags, links, link_chars, plain = max(n.tags, 1), max(n.links, 1), max(n.link_chars, 1), max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + body * n.chars + math.e)  # at least 1
            n.density = n.chars / tags * math.log(n.chars / link_chars * tags / links + 1) / math.log(max(base, math.e))
    for n in order:
        n.sum = sum(c.density for c in n.children if isinstance(c, Node) and not c.skip)
    return order


def best(node: Node) -> Node:
    """The node of greatest density sum in a subtree, the outermost of equals."""
    top, stack = node, [node]
    while stack:
        n = stack.pop()
        if n.sum > top.sum:
            top = n
        stack += [c for c in reversed(n.children) if isinstance(c, Node) and not c.skip]
    return top


def content(root: Node) -> set[int]:
    """The chosen subtrees, as ids of their top nodes.

    The node of greatest density sum is content. The least density on its path to the body is
    the threshold: in every other subtree whose density reaches it, the node of greatest sum is
    content too. A choice inside an article or main element stands for that element, so that its
    headline and short paragraphs stay.
    """
    order = measure(root)
    top = best(root)
    path, n = [], top
    while n is not None:
        path.append(n.density)
        n = n.parent
    limit = min(path)
    chosen: set[int] = set()

    def choose(n: Node) -> None:
        up, whole = n, n
        while up is not None:
            if up.name in ("article", "main"):
                whole = up
            up = up.parent
        chosen.add(id(whole))

    choose(top)
    for n in order[1:]:
        if n.density >= limit > 0 and not n.name == "a":
            choose(best(n))
    return chosen


def blocks(root: Node, chosen: set[int]) -> list[str]:
    """Texts of the block elements in the chosen subtrees, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    stack: list[tuple[object, bool]] = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                held.append(item)
        elif item.skip:
            continue
        elif item.name == "br":
            held.append(" ")
        else:
            inside = inside or id(item) in chosen
            if item.name in BLOCKS:
                flush()
                stack.append((None, False))
            stack += [(c, inside) for c in reversed(item.children)]
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by an empty line. Null and empty pages give an empty text."""
    if not html:
        return ""
    root = parse(html)
    return "\n\n".join(blocks(root, content(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page, from the whole html.

    Null and empty html, and pages without article text, give an empty text. Null ids and urls
    pass through, repeated rows are answered each, an empty table gives no rows, extra columns
    are ignored. Pages are independent: no shuffle.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    got = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col).cast("string")).alias("text"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
