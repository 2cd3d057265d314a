"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, adjusted for the share of link text;
its density sum is the sum over its children.  The node with the largest density sum is the core
of the article, the smallest density on the path from there to the body is the threshold, and
under every node above the threshold the subtree with the largest sum is taken.  Where all of it
lies in one ``article`` or ``main``, that element is the article as a whole.

Navigation, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles
and reader comments are told by element, role and class and not taken.  A class or a form may stand
around the article as well: what holds most of the body's text outside links, and the largest
``article`` or ``main`` where none stands elsewhere, is kept with all around it, and densities decide.
This does not hold for comments, nor for what is hidden or told by a role or another element.
Inside an ``article`` or ``main`` a class counts only where all of it, or what it begins with, names
no part of a text: an ``article-header`` or a ``related-work`` stays, a ``sidebar`` or an ``ad-slot``
goes.  Several articles that lie side by side are taken together, as far as their densities reach
the threshold.

Defined results: null and empty pages give an empty text, as do pages without text outside the
parts that are not taken; a page without tags is one block; unclosed elements end where their parent
does; equal density sums go to the node that starts first; repeated rows give repeated results;
columns other than the html pass through untouched, save those of the added names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgersieve.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)

# Elements by what they do to the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_ENDS_P = _BLOCK - {"body", "html"}
_SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CONTAINERS = frozenset(("ul", "ol", "dl", "table", "menu", "select"))
_NEVER = frozenset("nav aside form button select option dialog head title input fieldset object".split())
#: Elements of which nothing is text, up to their closing tag; one that is never closed is only a tag.
_CLOSED = frozenset("noscript template textarea iframe svg".split())
_PAGE_EDGE = frozenset(("header", "footer"))
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
_MARKS = re.compile(
    r"^(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banners?|cookies?|consent|gdpr|notices?|notification|alert|"
    r"newsletter|subscribe|subscription|signup|login|popup|modal|overlay|sidebar|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|"
    r"footer|header|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommended|recommendations|"
    r"skip|search|copyright|disclaimer|paywall|teaser|teasers)$"
)
_COMMENTS = re.compile(r"^(?:comments?|commentlist|disqus|respond|replies|reply)$")
#: First parts of a class that name no part of a text, also inside an article.
_CERTAIN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo sidebar nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager cookie cookies gdpr newsletter subscribe subscription signup login popup modal overlay widget widgets footer".split()
)
#: Classes that inside an article may stand for its own heading.
_OWN_HEADING = frozenset(("header", "masthead", "banner", "banners"))
#: Elements that may stand around a whole page.
_AROUND = frozenset(("form", "fieldset"))
#: Why a node is out by itself: a class or element that may also stand around the article, or for certain.
_SOFT, _HARD = 1, 2
_IGNORED_BEFORE = frozenset(("has", "no", "with", "without", "is", "not"))


class _Node:
    __slots__ = ("tag", "parent", "children", "out", "chars", "tags", "link_chars", "link_tags", "density", "sum", "link", "own", "article", "main")

    def __init__(self, tag: str, parent: _Node | None, own: int, link: bool):
        self.tag, self.parent, self.own, self.link = tag, parent, own, link
        self.article = tag == "article" or parent is not None and parent.article
        self.main = tag == "main" or parent is not None and parent.main
        self.out = False
        self.children: list[_Node | str] = []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.sum = 0.0


def _marked(attributes: str, inside: bool) -> int:
    """How surely class, id, role or style say that the element is no part of an article, or of the one it stands in."""
    found = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return _HARD
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _HARD
        if name in ("class", "id"):
            for token in value.split():
                parts = re.split(r"[-_]+", token)
                # Words after a negating one do not count: has-sidebar, content-with-sidebar.
                parts = parts[:next((i for i, part in enumerate(parts) if part in _IGNORED_BEFORE), len(parts))]
                if inside:
                    if len(parts) == 1 and _COMMENTS.match(parts[0]) or parts and parts[0] in ("comment", "comments", "commentlist", "disqus"):
                        return _HARD
                    if parts and (parts[0] in _CERTAIN or len(parts) == 1 and parts[0] not in _OWN_HEADING and _MARKS.match(parts[0])):
                        found = _SOFT
                    continue
                if any(map(_COMMENTS.match, parts)):
                    return _HARD
                if any(map(_MARKS.match, parts)):
                    found = _SOFT
    return found


def _tree(page: str) -> tuple[_Node, list[_Node]]:
    """The page's nodes, parents first.

    Open elements are counted by name, so a closing tag without an open element, of which a broken
    page may have any number, is passed over without a look at what is open.
    """
    root = _Node("#page", None, 0, False)
    nodes, at, last, place, open_, never_closed = [root], root, 0, 0, Counter(), set()

    def left(node: _Node, to: _Node) -> _Node:
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent
        return to

    while token := _TOKEN.search(page, place):
        place = token.end()
        if token.start() > last:
            at.children.append(page[last:token.start()])
        last = place
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        if token[2] or token[5]:
            if not open_[tag]:
                continue
            node = at
            while node is not root and node.tag != tag:
                if node.tag in _CONTAINERS and tag in _SAME_ENDS:
                    node = root
                    break
                node = node.parent
            if node is not root:
                at = left(at, node.parent)
            continue
        if tag in _CLOSED and tag not in never_closed:
            closing = re.compile(rf"</{tag}\s*+>", re.IGNORECASE).search(page, place)
            if closing:
                place = last = closing.end()
                continue
            never_closed.add(tag)
        if tag in _ENDS_P and open_["p"]:
            node = at
            while node is not root and node.tag not in _BLOCK:
                node = node.parent
            if node.tag == "p":
                at = left(at, node.parent)
        if tag in _SAME_ENDS and any(open_[t] for t in _SAME_ENDS[tag]):
            node = at
            while node is not root and node.tag not in _SAME_ENDS[tag] and node.tag not in _CONTAINERS:
                node = node.parent
            while node is not root and node.tag in _SAME_ENDS[tag]:
                at = left(at, node.parent)
                node = at
        attributes = token[4] or token[7] or ""
        own = (_SOFT if tag in _AROUND else _HARD) if tag in _NEVER else 0
        if tag not in ("html", "body", "main", "article"):
            marked = _marked(attributes, at.article or at.main) if attributes else 0
            if tag in _PAGE_EDGE:
                marked = _HARD
            # An article's own header stays, its footer and what is marked does not.
            if marked and not (tag == "header" and (at.article or at.main)):
                own = max(own, marked)
        elif tag == "article" and attributes and (at.article or "comment" in attributes.lower()):
            # Comments are often articles of their own.
            own = _HARD
        node = _Node(tag, at, own, at.link or tag == "a")
        at.children.append(node)
        nodes.append(node)
        if tag not in _VOID:
            at = node
            open_[tag] += 1
    if last < len(page):
        at.children.append(page[last:])
    if any(node.own == _SOFT for node in nodes):
        _keep_around(nodes)
    for node in nodes:
        node.out = node.own > 0 or node.parent is not None and node.parent.out
    return root, nodes


def _keep_around(nodes: list[_Node]) -> None:
    """Takes back the soft marks of what holds most of the text, and those around the article."""
    plain = {id(node): 0 for node in nodes}
    for node in reversed(nodes):
        if node.own == _HARD:
            plain[id(node)] = 0
            continue
        if not node.link:
            plain[id(node)] += sum(sum(map(len, c.split())) for c in node.children if isinstance(c, str))
        if node.parent is not None:
            plain[id(node.parent)] += plain[id(node)]
    # Parents stand before their children.
    state: dict[int, int] = {}
    for node in nodes:
        state[id(node)] = max(node.own, state[id(node.parent)] if node.parent is not None else 0)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    kept = [n for n in nodes if n.own == _SOFT and state[id(n)] == _SOFT and 2 * plain[id(n)] > plain[id(body)] and any(isinstance(c, _Node) for c in n.children)]
    articles = [n for n in nodes if n.tag in ("article", "main") and state[id(n)] < _HARD and plain[id(n)]]
    if any(not state[id(n)] for n in articles):
        kept = []
    elif articles:
        kept.append(max(articles, key=lambda n: plain[id(n)]))
    for node in kept:
        while node is not None:
            node.own, node = 0, node.parent


def _measure(nodes: list[_Node]) -> None:
    """Densities and density sums, children first.  A run of text beside elements counts as a child of its own."""
    own: list[list[int]] = []
    for node in nodes:
        own.append([sum(map(len, c.split())) for c in node.children if isinstance(c, str)])
    for node, runs in zip(reversed(nodes), reversed(own), strict=True):
        node.chars += sum(runs)
        if node.link:
            node.link_chars = node.chars
        if node.tag == "a":
            node.link_tags += 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    page_links = body.link_chars / max(body.chars, 1)

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        plain = max(chars - link_chars, 1)
        base = math.log(chars / plain * link_chars + page_links * chars + math.e)
        adjusted = math.log(max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.1)) / math.log(max(base, 1.1))
        return chars / tags * adjusted

    for node, runs in zip(nodes, own, strict=True):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
        if not node.out:
            node.sum = sum(density(n, 1, n if node.link else 0, 0) for n in runs)
    for node in nodes:
        if node.parent is not None and not node.out:
            node.parent.sum += node.density


def _article(nodes: list[_Node]) -> list[_Node]:
    """The subtrees that hold the article, in page order."""
    best = {}
    for node in reversed(nodes):
        here = best.get(id(node), node)
        if node.sum >= here.sum:
            here = node
        best[id(node)] = here
        up = node.parent
        if up is not None and not node.out:
            known = best.get(id(up))
            if known is None or here.sum >= known.sum:
                best[id(up)] = here
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    core = best[id(body)] if body.chars else best[id(nodes[0])]
    if not core.sum:
        core = best[id(nodes[0])]
        body = nodes[0]
    threshold, node = core.density, core
    while node is not None and node is not body:
        node = node.parent
        if node is not None:
            threshold = min(threshold, node.density)
    taken: list[_Node] = []
    open_ = [body]
    while open_:
        node = open_.pop()
        if node.out or node.density < threshold or not node.chars:
            continue
        found = best[id(node)]
        if found.sum:
            taken.append(found)
        open_ += [c for c in node.children if isinstance(c, _Node)]
    for whole in ("article", "main"):
        core_owner = _owner(core, whole)
        if core_owner is not None:
            # Articles beside that of the core are taken with it where they are as dense as the path to the core.
            beside = [n for n in core_owner.parent.children if isinstance(n, _Node) and n.tag == whole and not n.out and n.density >= threshold and 2 * n.link_chars < n.chars]
            owners = {id(o) for o in (_owner(n, whole) for n in taken) if o is not None} | {id(core_owner)}
            kept = [n for n in beside if n is core_owner or n.chars] or [core_owner]
            if owners <= {id(n) for n in kept} | {id(core_owner)}:
                return kept if core_owner in kept else [core_owner]
    chosen = {id(n) for n in taken}
    order = {id(n): i for i, n in enumerate(nodes)}
    return sorted((n for n in {id(n): n for n in taken}.values() if not _has_ancestor(n, chosen)), key=lambda n: order[id(n)])


def _owner(node: _Node, tag: str) -> _Node | None:
    found = None
    while node is not None:
        if node.tag == tag and not node.out:
            found = node
        node = node.parent
    return found


def _has_ancestor(node: _Node, chosen: set[int]) -> bool:
    node = node.parent
    while node is not None:
        if id(node) in chosen:
            return True
        node = node.parent
    return False


def _blocks(tops: list[_Node]) -> list[str]:
    blocks, run = [], []

    def close() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for top in tops:
        stack: list[_Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                run.append(item)
            elif not item.out:
                if item.tag in _BLOCK:
                    close()
                    stack.append(None)
                elif item.tag in ("br", "td", "th"):
                    run.append(" ")
                stack += reversed(item.children)
        close()
    return blocks


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by two line ends."""
    if not page:
        return ""
    _, nodes = _tree(page)
    _measure(nodes)
    return "\n\n".join(_blocks(_article(nodes)))


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with ``text`` and ``n_chars`` in place of the html."""
    added = T.StructType.fromDDL("text string, n_chars bigint")
    names = [c for c in pages.columns if c != html_col and c not in added.fieldNames()]
    pages = pages.select(*names, html_col)

    def run(batches):
        for batch in slices(batches, len(names), 4 << 20):
            texts = [main_text(page) for page in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*names, *added.fieldNames()],
            )

    return pages.mapInArrow(run, T.StructType([*[pages.schema[c] for c in names], *added.fields]))
