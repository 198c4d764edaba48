"""Main text of web pages by composite text density.

A page becomes a small DOM. Boilerplate by tag, role, class or id (menus, page headers, footers, sidebars, notices, adverts,
forms, comments) and what is never shown (scripts, styles, hidden nodes) is cut off, but not wrappers that hold the text.
Each node of the rest, also those within a line, gets its composite text density: characters per tag, adjusted for the part
of them inside links. A node's density sum adds the densities of its children. The node with the largest sum stands for the
content; the smallest density on its path to the body is the threshold. Going down from the body, each block that is as
dense as the threshold or denser gives the node of the largest sum in its subtree, and the union of these subtrees is the
text. A subtree that has at least half of an enclosing article is widened to it, as headings and short blocks belong to it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import map_batches, small_batches, spread

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: What a tag has between two quoted values, and the quote or the end of the tag behind it.
PLAIN = re.compile(r"""[^>=]*+(?:=(?!\s*+["'])[^>=]*+)*+(?:=\s*+(["'])|>)""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.S)
#: Elements whose content is no markup.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text: nodes for the density, but no blocks of the text.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr img".split()
)
DROPPED = set(
    "head title nav footer aside script style noscript template iframe svg math canvas object embed applet audio video button "
    "select textarea input dialog menu noembed noframes xmp".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
#: Parts of a class or id that mark boilerplate.
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus replies "
    "respond response responses widget toolbar pager pagination skip copyright".split()
)
KEPT = {"html", "body", "main", "article"}
#: Text in these is no running text; less than so much of it outside of marked nodes is no article.
NOT_RUNNING = {"a", "h1", "h2", "h3", "h4", "h5", "h6", "button", "label"}
LEAST_RUNNING = 40
#: Classes and ids that begin so tell what a layout has or lacks, not what the node is.
LAYOUT = {"has", "with", "no", "without"}
#: Marks of discussions: much text doesn't make these the page's content.
DISCUSSION = {"comment", "comments", "disqus", "replies", "respond", "response", "responses"}
#: An opening tag ends open elements of these kinds first.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Such an end looks no further up than to one of these.
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "main", "td", "th", "blockquote"}


class Scanner:
    """The tags of a page one after the other, in a time that grows with its length only. A tag whose end is hidden by a
    quote that never closes ends at its first bracket, and quotes count no more from there on."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Begin, end, whether it is an end tag, name (empty for comments and the like) and attributes."""
        page = self.page
        m = TAG.search(page, at)
        if not m:
            return None
        begin = m.start()
        if m[2] is None:
            comment = m.end() == begin + 4
            end = page.find("-->" if comment else ">", m.end())
            return begin, len(page) if end < 0 else end + (3 if comment else 1), False, "", ""
        end = self._end(m.end())
        if end < 0:  # cut off within a tag: nothing else can begin
            return begin, len(page), False, "", ""
        return begin, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]

    def _end(self, at: int) -> int:
        page, here = self.page, at
        while self.quotes and here <= self.last and (m := PLAIN.match(page, here)):
            if not m[1]:
                return m.end()
            here = page.find(m[1], m.end()) + 1
            if not here:
                break
        self.quotes = False
        return page.find(">", at) + 1 or -1 if at <= self.last else -1


class Node:
    __slots__ = ("children", "chars", "density", "inline", "links", "link_tags", "marks", "open", "parent", "scope", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.inline = tag, parent, [], tag in INLINE
        # the scope that it is in, or is itself; a scope counts its open elements, so that no search goes up in vain
        own = parent is None or tag in SCOPES
        self.scope, self.open = self if own else parent.scope, Counter() if own else None
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.sum = 0.0
        self.marks: set[str] = set()


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in KEPT:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _marks(tag: str, attributes: str, inside: bool) -> set[str]:
    """The parts of class and id that mark boilerplate; a form is marked as such."""
    found = {"form"} if tag == "form" else set()
    for name, *values in ATTRIBUTE.findall(attributes or ""):
        if name.lower() in ("class", "id"):
            for value in "".join(values).lower().split():
                parts = re.split(r"[_-]+", value)
                if parts[0] not in LAYOUT:
                    found |= {x for x in parts if x in BOILERPLATE or x == "header" and not inside}
    return found


def _cut(root: Node) -> None:
    """Marked nodes go, whatever their size. Only where the page without them has no article do those stay that wrap it: those
    that hold an unmarked article or main; where nothing marks one, and no running text is left without the marked nodes,
    those with most of the text at a low share of links, but no discussions."""
    nodes = _ordered(root)
    if not any(node.marks for node in nodes):
        return
    out, running, articles = {id(root): False}, 0, 0  # out: within a marked node; text left without these, in articles and at all
    within = {id(root): False}
    for node in nodes:
        for c in node.children:
            if isinstance(c, Node):
                out[id(c)] = out[id(node)] or bool(c.marks)
                within[id(c)] = within[id(node)] or c.tag in ("article", "main")
            elif not out[id(node)] and node.tag not in NOT_RUNNING and not (node.inline and node.parent and node.parent.tag in NOT_RUNNING):
                n = len(" ".join(c.split()))
                running, articles = running + n, articles + n * within[id(node)]
    chars, links, holds = {}, {}, {}
    for node in reversed(nodes):
        inner = [c for c in node.children if isinstance(c, Node)]
        chars[id(node)] = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str)) + sum(chars[id(c)] for c in inner)
        links[id(node)] = chars[id(node)] if node.tag == "a" else sum(links[id(c)] for c in inner)
        holds[id(node)] = node.tag in ("article", "main") and not node.marks or any(holds[id(c)] for c in inner)
    wraps = {id(c) for c in nodes if c.marks and holds[id(c)]} if not articles else set()
    if not articles and not wraps and running < LEAST_RUNNING:
        wraps = {id(c) for c in nodes if c.marks and not c.marks & DISCUSSION and 2 * chars[id(c)] > chars[id(root)] and links[id(c)] < 0.3 * chars[id(c)]}
    todo = [root]
    while todo:
        node = todo.pop()
        children = []
        for c in node.children:
            if isinstance(c, Node) and c.marks and id(c) not in wraps:
                if not c.inline:
                    children.append(Node("hr", node))  # still a border between blocks
                continue
            children.append(c)
            if isinstance(c, Node):
                todo.append(c)
        node.children = children


def parse(page: str) -> Node:
    """The DOM of a page without boilerplate; wrong nesting is mended as browsers do in the usual cases."""
    root = here = Node("body", None)
    at, dropped, inside = 0, 0, 0  # dropped: open elements within a dropped one; inside: open articles
    open_dropped: list[str] = []
    nested, opened = Counter(), Counter()  # of the open elements within a dropped one, and of those that are kept, how many of a tag
    scanner = Scanner(page)
    while at < len(page):
        found = scanner.next(at)
        text = page[at : found[0] if found else len(page)]
        if text and not dropped:
            here.children.append(entities.unescape(text) if "&" in text else text)
        if not found:
            break
        _, at, end, tag, attributes = found
        if not tag:
            continue
        closed = attributes.endswith("/")
        if dropped:  # only the nesting counts
            if not end and tag in RAW:
                at = _raw_end(page, at, tag)
            elif not end and tag not in VOID and not closed:
                open_dropped.append(tag)
                nested[tag] += 1
            elif end and nested[tag]:
                while (last := open_dropped.pop()) != tag:
                    nested[last] -= 1
                nested[tag] -= 1
            elif end and tag in ("article", "main", "body", "html"):
                open_dropped.clear()
                nested.clear()
                here = _close(here, tag, opened)
                inside -= tag in ("article", "main") and inside > 0
            dropped = len(open_dropped)
            continue
        if end:
            inside -= tag in ("article", "main") and inside > 0
            here = _close(here, tag, opened)
            continue
        if tag in ("html", "body"):
            continue
        if _boilerplate(tag, attributes, inside > 0):
            if tag not in INLINE:
                here = _open_scope(here, tag, opened)
            if tag in RAW:
                at = _raw_end(page, at, tag)
            elif tag not in VOID and not closed:
                open_dropped.append(tag)
                nested[tag] += 1
                dropped = 1
            if tag not in INLINE:
                here.children.append(Node("hr", here))  # still a border between blocks
            continue
        if tag in RAW:
            at = _raw_end(page, at, tag)
            continue
        if tag not in INLINE:
            here = _open_scope(here, tag, opened)
        node = Node(tag, here)
        node.marks = _marks(tag, attributes, inside > 0) if attributes or tag == "form" else node.marks
        here.children.append(node)
        if tag not in VOID and not closed:
            here.scope.open[tag] += 1
            opened[tag] += 1
            here = node
            inside += tag in ("article", "main")
    _cut(root)
    return root


def _raw_end(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
    if not m:
        return len(page)
    end = page.find(">", m.start())
    return len(page) if end < 0 else end + 1


def _open_scope(here: Node, tag: str, opened: Counter) -> Node:
    ends, node = CLOSES.get(tag, {"p"}), here
    if here.scope.tag not in ends and not any(here.scope.open[x] for x in ends):
        return here
    while node.parent and node.tag not in SCOPES - ends:
        if node.tag in ends:
            here = _left(here, node, opened)
            if "p" == node.tag or tag in ("li", "option"):
                break
        node = node.parent
    return here


def _left(here: Node, node: Node, opened: Counter) -> Node:
    """Closes all from here up to a node."""
    while here is not node.parent:
        opened[here.tag] -= 1
        here.parent.scope.open[here.tag] -= 1
        here = here.parent
    return here


def _close(here: Node, tag: str, opened: Counter) -> Node:
    inner = tag in INLINE or tag == "p"
    if not (here.scope.open[tag] if inner else opened[tag]):
        return here
    node = here
    while node.parent and node.tag != tag:
        if inner and node.tag in SCOPES:
            return here
        node = node.parent
    return _left(here, node, opened) if node.parent else here


def _ordered(root: Node) -> list[Node]:
    """Parents before children."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def weigh(root: Node) -> list[Node]:
    """Sets densities and density sums; returns the nodes, parents first."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        node.chars += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.links, node.link_tags = node.chars, 1
        if node.parent:
            up = node.parent
            up.chars, up.links, up.link_tags = up.chars + node.chars, up.links + node.links, up.link_tags + node.link_tags
            up.tags += node.tags + 1
    ratio = root.links / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.links, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        node.density = c / t * math.log((c / max(lc, 1)) * (t / max(lt, 1)) + 1e-9, max(base, 1 + 1e-9)) if c else 0.0
        node.density = max(node.density, 0.0)
    for node in nodes:
        if node.parent:
            node.parent.sum += node.density
    return nodes


def content(root: Node) -> set[int]:
    """The ids of the roots of the subtrees that are content."""
    nodes = weigh(root)
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        of = best.get(id(node), node)
        of = node if node.sum >= of.sum else of
        best[id(node)] = of
        if node.parent and (id(node.parent) not in best or of.sum >= best[id(node.parent)].sum):
            best[id(node.parent)] = of
    top, threshold = best[id(root)], math.inf
    node = top
    while node:
        threshold = min(threshold, node.density)
        node = node.parent
    found: dict[int, Node] = {}
    for node in nodes:
        if not node.inline and node.chars and node.density >= threshold:
            of = best[id(node)] if best[id(node)].sum > 0 else node
            found[id(of)] = of
    return {id(_widened(node)) for node in found.values()}


def _widened(node: Node) -> Node:
    """Up to the block that it is in, and the outermost article or main of which it has half of the text."""
    found, up = node, node.parent
    while up and (found.inline or 2 * node.chars >= up.chars):
        found = up if found.inline or up.tag in ("article", "main") else found
        up = up.parent
    return found


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order joined by two line feeds."""
    if not page:
        return ""
    root = parse(page)
    marked = content(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        node, kept = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if kept:
                line.append(node)
        else:
            kept = kept or id(node) in marked
            cell = node.tag in ("td", "th")
            if cell or node.tag in ("br", "img"):
                line.append(" ")
            elif not node.inline:
                flush()
                stack.append((None, kept))
            stack += [(c, kept) for c in reversed(node.children)]
    flush()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    A null or empty html gives an empty text, a null url stays null, repeated pages stay repeated, and other columns are
    ignored. Deep nesting and long pages need no recursion.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(spread(source), run, "page_id long, url string, text string, n_chars long")
