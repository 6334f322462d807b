"""Main text of HTML pages by scoring their element trees.

A page becomes a tree of elements. Subtrees that never hold the article go (scripts,
styles, forms, menus, footers, side columns, and elements whose class, id or role
names them as such, as an advert, a notice or reader comments). Each paragraph gives
points for its length and its commas to its parent, half to the grandparent, a third
to the next, and so on; a container's points are cut by its share of text in links.
The article or main part around the best container is kept, with those of its siblings
that score near it or read as prose. On pages without either, it is the outermost ancestor
that holds further prose, less what is mostly links on the way there. What is left is turned into blocks in page order.

The whole page is read, whatever its length or depth; nesting is kept on a list, not
on the call stack. Null and empty pages give the empty text. Markup that is not
closed, crossed or cut off ends with its parent. Repeated pages are read alike.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from offerlens.llm.arrow import map_batches, texts

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_GONE = frozenset(
    "script style noscript template iframe object embed svg math canvas head title nav footer aside form button select "
    "textarea input label fieldset dialog menu audio video map noembed noframes xmp".split()
)
_BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre "
    "figure figcaption header hgroup address details summary center hr".split()
)
_PARAGRAPH = frozenset("p pre blockquote li dd td figcaption h1 h2 h3 h4 h5 h6".split())
# A start tag of the group on the left ends an open element of the group on the right.
_P_ENDERS = _BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body"} | {"form", "nav", "footer", "aside", "fieldset", "menu"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup paywall nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer "
    "masthead topbar toolbar comment comments disqus reply replies respondlist share sharing social related recommended recommendations "
    "pagination pager skip login search searchbox widget widgets toc copyright".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PROSE, LINKED = 80, 0.5  # characters of prose, share of text in links that is none
_CONTAINERS = frozenset("article main section div body html td center details figure blockquote".split())


class Node:
    __slots__ = ("tag", "noise", "parts", "parent", "points", "length", "linked")

    def __init__(self, tag: str, noise: bool, parent: "Node | None"):
        self.tag, self.noise, self.parent = tag, noise, parent
        self.parts: list[str | Node] = []
        self.points = 0.0
        self.length = self.linked = 0


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _GONE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in _NOISE_ROLES:
            return True
        if name in ("class", "id") and tag not in ("article", "main"):
            # A name is noise by its first or last part: "comment-list", "site-footer".
            for one in value.split():
                parts = [w.lower() for w in _WORD.findall(one)]
                if parts and (parts[0] in _NOISE_WORDS or parts[-1] in _NOISE_WORDS):
                    return True
    return False


def parse(page: str) -> Node:
    """The element tree; text parts are decoded."""
    root = Node("html", False, None)
    node, done, articles = root, 0, 0
    position = 0
    search = _TOKEN.search
    while m := search(page, position):
        if m.start() > done:
            node.parts.append(_html.unescape(page[done : m.start()]))
        done = position = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            at: Node | None = node
            while at is not None and at.tag != tag and not (at.tag in ("table", "article") and tag not in ("body", "html", at.tag)):
                at = at.parent
            if at is not None and at.tag == tag and at.parent is not None:
                node = at.parent
            elif tag == "br":
                node.parts.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                node.parts.append(" ")
            continue
        if tag in _P_ENDERS:
            at = node
            while at is not None and at.tag not in _BLOCK:
                at = at.parent
            if at is not None and (at.tag == "p" or at.tag[0] == "h" and at.tag[1:].isdigit()) and at.parent is not None:
                node = at.parent
        if tag in _ENDS:
            closes, limits = _ENDS[tag]
            at, found = node, None
            while at is not None and at.tag not in limits:
                if at.tag in closes:
                    found = at
                at = at.parent
            if found is not None and found.parent is not None:
                node = found.parent
        inside = tag == "header" and _within(node, ("article", "main"))
        child = Node(tag, _is_noise(tag, m.group(3), inside), node)
        node.parts.append(child)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, done)
            stop = end.start() if end else len(page)
            done = position = end.end() if end else len(page)
            if tag in ("title",):
                child.parts.append(page[m.end() : stop])
        elif tag not in _VOID and not m.group(3).endswith("/"):
            node = child
    if done < len(page):
        rest = page[done:]
        cut = rest.rfind("<")  # a tag that the page's end cuts off
        node.parts.append(_html.unescape(rest if cut < 0 or not re.match(r"</?[a-zA-Z!?]", rest[cut:]) else rest[:cut]))
    return root


def _within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _in_order(root: Node) -> list[Node]:
    """Elements that are no noise, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def _text_of(node: Node) -> str:
    out: list[str] = []
    todo: list[str | Node] = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif not part.noise:
            todo += reversed(part.parts)
    return " ".join("".join(out).split())


def _score(nodes: list[Node]) -> None:
    for node in reversed(nodes):  # children first
        own = sum(len(p) - p.count(" ") if isinstance(p, str) else 0 for p in node.parts)
        node.length += own
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    for node in nodes:
        if node.tag not in _PARAGRAPH and not any(isinstance(p, str) and p.strip() for p in node.parts):
            continue
        if node.tag not in _PARAGRAPH and node.tag not in _CONTAINERS:
            continue
        text = _text_of(node) if node.tag in _PARAGRAPH else " ".join(p for p in node.parts if isinstance(p, str))
        if not text.strip():
            continue
        points = 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)
        points *= 1 - node.linked / max(1, node.length)
        at, share = (node.parent if node.tag in _PARAGRAPH else node), 1
        while at is not None:
            at.points += points / share
            at, share = at.parent, share + 1
    for node in nodes:
        if node.tag in ("article", "main"):
            node.points = node.points * 1.5 + 25
        node.points *= 1 - node.linked / max(1, node.length)


def _chosen(nodes: list[Node]) -> list[Node]:
    """The best container and those siblings that belong to it."""
    best = max((n for n in nodes if n.tag in _CONTAINERS and n.length), key=lambda n: n.points, default=None)
    if best is None:
        return nodes[:1]
    # The article that holds the best container, or else the main part, is the whole of it.
    above: list[Node] = []
    at = best.parent
    while at is not None:
        above.append(at)
        at = at.parent
    whole = [n for n in above if n.tag == "article" and not n.noise] or [n for n in above if n.tag == "main" and not n.noise and best.tag != "article"]
    if whole:
        best = whole[-1]
    elif best.tag not in ("article", "main"):
        return [_sections(best, above)]
    if best.parent is None:
        return [best]
    least, out = max(10.0, best.points * 0.2), []
    for part in best.parent.parts:
        if not isinstance(part, Node) or part.noise:
            continue
        density = part.linked / max(1, part.length)
        if part is best or part.tag in _CONTAINERS and part.points >= least:
            out.append(part)
        elif part.tag in _PARAGRAPH and part.length and density < 0.25 and (part.length > 80 or best.tag not in ("article", "main")):
            out.append(part)
    return out


def _sections(best: Node, above: list[Node]) -> Node:
    """The outermost ancestor that holds further prose, at least the parent. On the way
    there, what is mostly links goes; all else belongs to the article, however short."""
    top, inner = 0, best
    for level, node in enumerate(above):
        if any(_prose(p) for p in node.parts if p is not inner):
            top = level
        inner = node
    inner = best
    for node in above[: top + 1]:
        for part in node.parts:
            if isinstance(part, Node) and part is not inner and part.linked >= LINKED * max(1, part.length):
                part.noise = True
        inner = node
    return inner


def _prose(part: "str | Node") -> bool:
    if isinstance(part, str):
        return len(part.strip()) > PROSE
    return not part.noise and part.length > PROSE and part.linked < LINKED * part.length


def blocks(chosen: list[Node]) -> list[str]:
    """Texts between block borders, in page order, white space as single spaces."""
    out: list[str] = []
    held: list[str] = []
    border = object()

    def close() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append(text)
            held.clear()

    todo: list = [n for n in reversed(chosen)]
    while todo:
        part = todo.pop()
        if part is border:
            close()
        elif isinstance(part, str):
            held.append(part)
        elif not part.noise:
            block = part.tag in _BLOCK
            if block:
                close()
                todo.append(border)
            todo += reversed(part.parts)
    close()
    return out


def main_text(page: str) -> str:
    if not page or page.isspace():
        return ""
    nodes = _in_order(parse(page))
    _score(nodes)
    return "\n".join(blocks(_chosen(nodes)))


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, the main ``text`` and its length ``n_chars`` in code points."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(x) for x in texts(batch.column(len(keep)))]
            return pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*keep, "text", "n_chars"]
            )

        return apply

    return map_batches(df.select(*keep, html), make, schema)
