"""Main text of web pages by composite text density.

Each page becomes a small DOM tree. For every node the characters per tag are computed and lowered by its share of
link text; the densities of a node's children are summed; the node with the largest sum is the core. The least
density on the path from the body to the core is the threshold. If the core lies in an ``article`` (else a ``main``),
that element and the articles beside it are the text; otherwise the core and every subtree beside the path to it
whose density reaches the threshold. Menus, headers, footers, sidebars, forms, scripts and styles are cut beforehand
by element and role; notices, adverts and reader comments by class names, if all words of a name speak for it. What
holds an article, or a form that holds most of a page's text, is never cut. Within the text, lists of bare links go.
"""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of the HTML standard by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noembed noframes xmp textarea title".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option legend".split()
)
CLOSES_P = BLOCKS - set("html body td th tr tbody thead tfoot li dd dt option caption legend summary".split())
#: An element that opens closes an open one of these, unless a barrier stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
CUT = set("head script style noscript template iframe object svg canvas math nav aside footer select textarea input dialog menu title audio video noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class names and ids: of reader comments, of other boilerplate, and words that say nothing.
TALK = set("comment comments commentlist respond response responses reply replies disqus discussion feedback talkback guestbook reader readers".split())
NAMES = TALK | set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions sidebar nav navbar navigation menu breadcrumb"
    " breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social related recommended recommendations pagination pager toolbar paywall banner widget copyright disclaimer".split()
)
PLAIN = set(
    "a an the of for and to on in at by box boxes block blocks list bar bars wrap wrapper container area section sections unit slot zone panel inner outer body text site page main"
    " top bottom left right header head title link links post posts item items article articles story stories news button buttons icon icons content message info data row col column"
    " small large big global primary secondary footer form thread threads user users count policy media js id google dfp".split()
)
HEADINGS = {"header", "masthead"}
#: Blocks that belong to the text beside them even where they are short.
PROSE = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
MANY_LINKS = 3
#: Blocks within a container of the core may be so many times sparser than the threshold.
SPARSER = 3
WHOLE = {"html", "body", "main", "article"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "held", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: str, up: "Node | None"):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []


def parse(page: str) -> Node:
    """The tree of a page; unclosed elements end where the standard lets them end, stray end tags are skipped."""
    root = now = Node("#root", "", None)
    # How many elements of a name are open, so that nobody climbs for one that isn't.
    opened: Counter = Counter()
    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        if not found:
            now.kids.append(page[at:])
            break
        if found.start() > at:
            now.kids.append(page[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                now.kids.append(found[0][9:].removesuffix("]]>"))
            continue
        if found[1]:
            if opened[tag]:
                node = now
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.up
                opened[tag] -= 1
                now = node.up
            continue
        room = _make_room(now, tag, opened)
        while now is not room:
            opened[now.tag] -= 1
            now = now.up
        node = Node(tag, found[3], now)
        now.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not (found[3].endswith("/") and tag in ("svg", "path")):
            now = node
            opened[tag] += 1
    return root


def _make_room(now: Node, tag: str, opened: Counter) -> Node:
    """The element that is left open when what ``tag`` closes is closed."""
    for closed, barriers in ((CLOSES.get(tag), BARRIERS.get(tag, {"table"})), ({"p"} if tag in CLOSES_P else None, {"button", "table", "td", "th", "li", "div", "article", "section"})):
        if closed and any(opened[c] for c in closed):
            node = now
            while node.up and node.tag not in barriers:
                if node.tag in closed:
                    now = node.up
                    if len(closed) == 1:
                        break
                node = node.up
    return now


def names_of(node: Node) -> tuple[set[str], bool]:
    """The words of those class names and ids that are boilerplate's, and whether attributes cut the element."""
    found: set[str] = set()
    if not node.attrs or node.attrs.isspace():
        return found, False
    for m in ATTRIBUTE.finditer(node.attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return found, True
        if key == "role" and value.lower() in ROLES:
            return found, node.tag not in WHOLE
        if key in ("class", "id"):
            for part in value.split():
                words = {w.lower() for w in WORD.findall(part) if not w.isdigit()}
                if words & (NAMES | HEADINGS) and words <= NAMES | PLAIN | HEADINGS:
                    found |= words & (NAMES | HEADINGS)
    return found, False


def boilerplate(node: Node, in_article: bool, page_chars: int) -> bool:
    """Whether an element is none of the article, by its name, role, class or id. ``chars`` and ``held`` must be known."""
    if node.tag in ("html", "body"):
        return False
    if node.tag in CUT:
        return True
    if node.tag == "button":  # within a sentence it is part of it
        return not any(isinstance(k, str) and k.strip() for k in node.up.kids)
    names, cut = names_of(node)
    if names & TALK and "h1" not in node.held:
        return True
    if node.tag in WHOLE or {"article", "main"} & node.held:
        return False
    if cut or node.tag == "form" or node.tag == "header" and not in_article:
        return cut or node.tag == "header" or 2 * node.chars < page_chars
    return bool(names & NAMES or not in_article and names & HEADINGS) and 2 * node.chars < page_chars


def prune(root: Node) -> list[Node]:
    """Cut boilerplate; the nodes that stay, each after its parent."""
    order = [root]
    for node in order:
        order.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        node.chars, node.held = 0, set()
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len(kid.strip())
            elif kid.tag not in CUT:
                node.chars += kid.chars
                node.held |= kid.held | ({kid.tag} & {"article", "main", "h1"})
    page_chars, order, stack = root.chars, [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        kept = []
        for kid in node.kids:
            if isinstance(kid, Node):
                if boilerplate(kid, inside, page_chars):
                    kept.append(" ")
                    continue
                stack.append((kid, inside or kid.tag in ("article", "main")))
            elif "&" in kid:
                kid = html.unescape(kid)
            kept.append(kid)
        node.kids = kept
    return order


def densities(order: list[Node]) -> None:
    """Characters per tag, adjusted by links as composite text density has it, and the sums over children."""
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for kid in node.kids:
            if isinstance(kid, Node):
                node.chars += kid.chars
                node.tags += kid.tags + 1
                node.link_chars += kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a")
            else:
                node.chars += len(kid.strip())
        if node.tag == "a":
            node.link_chars = node.chars
    share = order[0].link_chars / max(order[0].chars, 1)
    for node in order:
        node.density = 0.0
        if node.chars:
            plain, linked = max(node.chars - node.link_chars, 1), max(node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / linked * (max(node.tags, 1) / max(node.link_tags, 1))
            node.density = node.chars / max(node.tags, 1) * max(math.log(max(ratio, 1e-9)), 0.0) / max(math.log(base) if base > math.e else 1.0, 1.0)
    for node in order:
        node.total = sum(kid.density for kid in node.kids if isinstance(kid, Node))


def bare_links(node: Node) -> bool:
    """Whether a block is a list of links and nothing else."""
    return node.tag in BLOCKS and node.tag not in WHOLE and node.link_tags >= MANY_LINKS and 10 * node.link_chars > 9 * node.chars


def article(order: list[Node]) -> list[Node | str]:
    """The nodes whose text is the article, in page order."""
    best = max(order, key=lambda n: n.total)
    if not best.total:
        best = max(order, key=lambda n: n.density)
    if not best.chars:
        return []
    path = [best]
    while path[-1].up and path[-1].tag not in ("body", "#root"):
        path.append(path[-1].up)
    inside = next((n for tag in ("article", "main") for n in reversed(path) if n.tag == tag), None)
    held = [n for n in order if n.tag in ("article", "main") and n.chars] if inside is None else []
    if inside is None and held and 2 * sum(n.chars - n.link_chars for n in held if not {"article", "main"} & _above(n)) >= best.chars - best.link_chars:
        inside = max(held, key=lambda n: (n.tag == "article", n.total))  # the core is what surrounds articles
    if inside is not None:
        beside = [n for n in inside.up.kids if isinstance(n, Node)] if inside.up else [inside]
        heading = [n for n in beside[: beside.index(inside)] if n.tag == "h1"]
        return [n for n in beside if n is inside or n in heading or n.tag == inside.tag == "article" and 2 * n.link_chars < n.chars]
    threshold, on_path = min(n.density for n in path), set(map(id, path))
    out: list[Node | str] = []

    def belongs(node: Node, above: Node) -> bool:
        if 2 * node.link_chars >= node.chars:
            return False
        if node.density >= threshold:
            return True
        return above.tag not in ("body", "#root") and (node.tag in PROSE or node.tag not in BLOCKS or node.density * SPARSER >= threshold)

    stack: list[Node | str] = [path[-1]]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or id(node) not in on_path or node is best:
            out.append(node)
            continue
        for kid in reversed(node.kids):
            if isinstance(kid, str) or id(kid) in on_path or kid.chars and belongs(kid, node):
                stack.append(kid)
    return out


def _above(node: Node) -> set[str]:
    found = set()
    while node.up:
        node = node.up
        found.add(node.tag)
    return found


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the block elements in page order, white space as single spaces; a line break counts as a space."""
    out, now = [], []

    def flush():
        line = " ".join("".join(now).split())
        now.clear()
        if line:
            out.append(line)

    stack: list = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            now.append(node)
        elif node.tag == "br":
            now.append(" ")
        else:
            if bare_links(node):
                flush()
                continue
            if node.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(node.kids))
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by line feeds; empty for null, empty and textless pages."""
    if not page:
        return ""
    order = prune(parse(page))
    densities(order)
    return "\n".join(blocks(article(order)))


@F.arrow_udf(StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p) for p in pages.to_pylist()], pa.string())


def main_text(page: Column) -> Column:
    """The main text of an HTML column. Pages are independent rows, so nothing is shuffled."""
    return _extract(page)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of ``html_col``; columns of these names are replaced."""
    return pages.withColumn("text", main_text(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long")).drop(html_col)
