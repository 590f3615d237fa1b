"""Main-text extraction from web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_RAW = re.compile(r"</(script|style|noscript|template|iframe|textarea|title|svg)\b[^>]*>", re.I)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLANK = re.compile(r"\s+")
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = {"p", "div", "article", "section", "main", "aside", "nav", "header", "footer", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "form", "figure", "figcaption", "dl", "dt", "dd", "body", "html", "hr", "br", "fieldset", "details", "summary", "address", "tbody", "thead"}
#: Blocks that end an open paragraph, as in browsers.
ENDS_P = BLOCK - {"br", "td", "th", "tr", "body", "html", "tbody", "thead"}
#: An opening tag of the first closes an open one of the second, if nothing of the third lies between.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "menu"}
#: What a page's content is in by definition, whatever its name.
CONTENT = {"html", "body", "main", "article"}
_BAD = re.compile(r"\b(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|popup|promo|related|share|sidebar|social|sponsor\w*|subscribe)\b", re.I)
_GOOD = re.compile(r"\b(?:article|body|content|entry|main|post|story|text)\b", re.I)


class Node:
    __slots__ = ("tag", "parent", "kids", "score", "chars", "linked", "bad")

    def __init__(self, tag: str, parent: Node | None, score: float = 0.0, bad: bool = False) -> None:
        self.tag, self.parent, self.kids, self.score, self.chars, self.linked, self.bad = tag, parent, [], score, 0, 0, bad


def parse(page: str) -> Node:
    """The page's tree, forgiving as browsers are: implied ends, stray ends ignored, raw elements and comments skipped."""
    root = now = Node("#root", None)
    at, opened = 0, Counter()  # what isn't open needn't be looked for among the ancestors

    def close(upto: Node) -> Node:
        n = now
        while n is not upto.parent:
            opened[n.tag] -= 1
            n = n.parent
        return n

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            now.kids.append(page[at:])
            break
        if m.start() > at:
            now.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                now.kids.append(m[1])
            continue
        tag = tag.lower()
        if m[2]:
            if opened[tag]:
                up = now
                while up.tag != tag:
                    up = up.parent
                now = close(up)
            elif tag == "p":
                now.kids.append(Node("p", now))
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = next((e for e in _RAW.finditer(page, at) if e[1].lower() == tag), None)
                at = end.end() if end else len(page)
            continue
        if tag in ENDS_P and opened["p"]:
            up = now
            while up is not root and up.tag != "p" and up.tag not in ("td", "th", "div", "li", "article", "section"):
                up = up.parent
            if up.tag == "p":
                now = close(up)
        if tag in IMPLIED and any(opened[x] for x in IMPLIED[tag][0]):
            closes, stops = IMPLIED[tag]
            up, found = now, None
            while up is not root and up.tag not in stops:
                if up.tag in closes:
                    found = up
                up = up.parent
            if found:
                now = close(found)
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(m[4])) if m[4] else ""
        bad = tag in BOILERPLATE or bool(tag not in CONTENT and named and _BAD.search(named) and not _GOOD.search(named))
        node = Node(tag, now, 25.0 * bool(named and not bad and _GOOD.search(named)) + 10.0 * (tag in ("article", "main")), bad)
        now.kids.append(node)
        if tag not in VOID and not m[0].endswith("/>"):
            now = node
            opened[tag] += 1
    return root


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first; each gets the length of its text and of what is in links, without boilerplate."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if type(k) is Node]
    for n in reversed(order):
        n.chars = n.linked = 0
        for k in n.kids:
            if type(k) is Node:
                if not k.bad:
                    n.chars += k.chars
                    n.linked += k.linked
            else:
                n.chars += len(k.strip())
        if n.tag == "a":
            n.linked = n.chars
    return order


def _free_forms(nodes: list[Node], least_chars: int) -> bool:
    """Whether a form holds at least half of what paragraphs have outside other boilerplate; such forms then count as content."""
    held, form, total = Counter(), {}, 0
    for n in nodes:  # parents first; form: the outermost one around a node, or None; no entry below other boilerplate
        if n.parent is not None and id(n.parent) not in form or n.bad and n.tag != "form":
            continue
        form[id(n)] = (form[id(n.parent)] if n.parent is not None else None) or (n if n.bad else None)
        if n.tag in ("p", "pre", "td", "blockquote") and n.chars >= least_chars:
            total += n.chars
            held[id(form[id(n)])] += n.chars
    free = {id(f) for f in form.values() if f is not None and held[id(f)] and 2 * held[id(f)] >= total}
    for n in nodes:
        if form.get(id(n)) is not None and id(form[id(n)]) in free and n.tag == "form":
            n.bad = False
    return bool(free)


def _text(node: Node) -> str:
    """The text, a line for each block; blanks run together, entities resolved, boilerplate left out."""
    out, stack = [], [node]
    while stack:
        k = stack.pop()
        if k is None:
            out.append("\n")
        elif type(k) is not Node:
            out.append(_BLANK.sub(" ", k))
        elif not k.bad or k is node:
            if k.tag in BLOCK:
                out.append("\n")
                stack.append(None)
            stack.extend(reversed(k.kids))
    text = html.unescape("".join(out))
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


def extract(page: str | None, *, least_chars: int = 25, sibling_share: float = 0.2) -> tuple[str, float, str]:
    """(text, score, tag of the best container).

    Each paragraph of ``least_chars`` or more scores 1, a point for each comma and up to 3 for each 100 characters; its parent
    gets that, and every further ancestor up to the body half of what the one below it got. A container's score is discounted by the share
    of its text in links. The best container is kept, with siblings that score ``sibling_share`` of it, or are paragraphs of
    prose with few links. A form that holds half of the page's paragraphs or more is no boilerplate. A page without such paragraphs
    gives all its text outside boilerplate, with score 0; if all of it is in boilerplate, then that.
    """
    if not page:
        return "", 0.0, ""
    root = parse(page)
    nodes = _measure(root)
    if _free_forms(nodes, least_chars):
        nodes = _measure(root)
    hidden: set[int] = set()
    points: dict[int, float] = {}
    for n in nodes:  # parents first
        if n.bad or n.parent is not None and id(n.parent) in hidden:
            hidden.add(id(n))
        elif n.tag in ("p", "pre", "td", "blockquote") and n.chars >= least_chars:
            points[id(n)] = 1 + sum(k.count(",") for k in _strings(n)) + min(n.chars // 100, 3)
    scored: dict[int, Node] = {}
    got: dict[int, float] = {}
    for n in reversed(nodes):  # children first: what a node passes on is its own points and half of what it got
        on = points.get(id(n), 0) + got.get(id(n), 0) / 2
        if id(n) in got and n.tag not in ("#root", "html"):
            n.score += got[id(n)]
            scored[id(n)] = n
        if on and n.parent is not None:
            got[id(n.parent)] = got.get(id(n.parent), 0) + on
    if not scored:
        text = _text(root)
        if not text:
            for n in nodes:
                n.bad = False
            text = _text(root)
        return text, 0.0, ""
    final = {i: n.score * (1 - n.linked / max(1, n.chars)) for i, n in scored.items()}
    best = max((n for n in nodes if id(n) in scored), key=lambda n: final[id(n)])
    top, parent, parts = final[id(best)], best.parent, []
    for k in parent.kids if parent is not None else [best]:
        if type(k) is not Node or k.bad and k is not best:
            continue
        density = k.linked / max(1, k.chars)
        if k is best or final.get(id(k), 0) >= max(10, top * sibling_share) or k.tag in ("p", "h1") and (k.chars > 80 and density < 0.25 or k.chars and not k.linked and k.tag == "h1"):
            parts.append(_text(k))
    return "\n".join(x for x in parts if x), top, best.tag


def _strings(n: Node) -> Iterator[str]:
    stack = [n]
    while stack:
        for k in stack.pop().kids:
            if type(k) is Node:
                if not k.bad:
                    stack.append(k)
            else:
                yield k


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, score, container) for each page, by extract().

    Null or empty page: empty text and container, score 0. Null page_id or url: kept. Repeated rows: each is extracted. Of containers that score
    alike the outermost, then the first counts. Empty table: no row. Other columns of ``pages`` aren't read.
    """
    source = pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url"), col(page).alias("h"))
    out = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("container", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                done = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([round(d[1], 6) for d in done], pa.float64()), pa.array([d[2] for d in done], pa.string())], ["page_id", "url", "text", "score", "container"])

    return source.mapInArrow(run, out)
