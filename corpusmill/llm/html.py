"""Main text of HTML pages by tree scoring.

A tolerant parser builds the element tree. Paragraphs pass points, for their length and commas, to the elements above
them, fewer the further up; an element's points count less the more of its text is links. The best container and its
siblings that score or read like text are kept, without menus, forms, notices and the like inside.

Defined cases: a null or empty page, and one without text, gives an empty string; unclosed, crossed and unknown tags are
accepted; nesting of any depth is (nothing recurses), in time in proportion to the page; text of any length is kept whole;
other columns pass through `with_main_text` except one named like what it makes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag from its "<". Quotes count after "=" only; one that is never closed is a letter like others.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)>")
#: The same up to the next ">", for pages whose quotes run to their end.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))?)?")
RAW = {"script", "style", "noscript", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
#: Searched in the page itself: str.lower() may change its length. ASCII only.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
#: An opening tag ends these, up to the element that bounds the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: No end tag but a block's reaches across these.
WALLS = {"table", "article", "main", "body"}
DROP = {"head", "nav", "aside", "form", "input", "dialog", "menu", "fieldset", "svg", "object", "select", "canvas", "audio", "video", "template", *RAW}
#: Controls; part of a sentence where text stands beside them.
SOFT = {"button", "label"}
NOISE = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus footer gdpr hidden login masthead menu menus modal nav navbar navbars navigation newsletter notice notices overlay pager pagination paywall popup promo promotion "
    "promotions recommendation recommendations recommended related replies reply respond share shares sharing shoutbox sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar "
    "topbar widget widgets".split()
)
#: What may follow a word of noise in a name: cookie-box is noise, notice-period isn't.
PLACES = set(
    "area aside bar bars block blocks body bottom box boxes btn button buttons center cell column columns container content count element elements entry field fieldset fields footer form frame grid group header heading "
    "holder icon icons inner item items label layer left line link links list lists logo main message messages nav outer panel panels placeholder popup post posts primary region right row rows secondary section sections slot "
    "story stories strip tab tabs text thread title toggle top unit units view wrap wrapper zone".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "form", "alert"}
GOOD = set("article body content entry main page post story text blog".split())
TEXTUAL = {"p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "figcaption"}
#: Beside the best container these are kept unless they are links.
PROSE = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "figure"}
SPLIT_NAME, CAMEL, NUMBER = re.compile(r"[^a-z0-9]+"), re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"[0-9]+x?[0-9]*")
STRONG = re.compile(r"sidebar|cookie|advert|newsletter|breadcrumb|navbar|popup|adsby")
STATES = {"has", "no", "with", "without", "open", "closed", "enabled", "disabled"}
OWN = {"article", "post", "entry", "story", "blog"}


class Node:
    __slots__ = ("tag", "names", "up", "own", "drop", "text", "links", "commas", "points", "inside")

    def __init__(self, tag: str, names: list[str], up: Node | None, drop: bool):
        self.tag, self.names, self.up, self.drop = tag, names, up, drop
        self.own: list = []  # texts and nodes in page order
        self.text = self.links = self.commas = 0
        self.points: float | None = None
        self.inside = tag in ("article", "main") or bool(up and up.inside)


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _parts(name: str) -> list[str]:
    """Words of a class name or id; capitals inside start one."""
    return [x for x in SPLIT_NAME.split(CAMEL.sub(r"\1 \2", name).lower()) if x]


def _noisy(name: str, inside: bool) -> bool:
    """Whether one class name or id marks what is no part of an article: its last word does, but for words of place and
    numbers. Names of states, as has-sidebar or comments-open, do not."""
    parts = _parts(name)
    if STATES & set(parts):
        return False
    for x in reversed(parts):
        if x in NOISE or STRONG.search(x):
            return True
        if x == "header" and not inside and not OWN & set(parts):
            return True
        if x not in PLACES and not NUMBER.fullmatch(x) and len(x) > 1:
            return False
    return False


def _noise(tag: str, at: dict[str, str], up: Node) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in DROP or at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden") == "true":
        return True
    if tag in ("header", "footer") and not (tag == "header" and up.inside):
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I):
        return True
    return any(_noisy(n, up.inside) for n in f"{at.get('class', '')} {at.get('id', '')}".split())


class Open:
    """The open elements, and where in them each tag is, so that finding one takes no walk."""

    def __init__(self, root: Node):
        self.stack, self.at, self.walls, self.blocks = [root], {"html": [0]}, [0], [0]

    def push(self, node: Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in WALLS:
            self.walls.append(i)
        if node.tag in BLOCK:
            self.blocks.append(i)

    def close(self, index: int) -> None:
        while len(self.stack) > max(index, 1):
            tag, i = self.stack.pop().tag, len(self.stack)
            self.at[tag].pop()
            for x in (self.walls, self.blocks):
                if x[-1] == i:
                    x.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost of these, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def parse(html: str) -> list[Node]:
    """All elements in page order, the root first. It takes time in proportion to the page."""
    root = Node("html", [], None, False)
    nodes, open_, at, look, size, tags = [root], Open(root), 0, 0, len(html), TAG

    def add(text: str) -> None:
        if text:
            open_.stack[-1].own.append(unescape(text) if "&" in text else text)

    while (lt := html.find("<", look)) >= 0:
        c = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = lt + 4 if html.startswith(">", lt + 4) else lt + 5 if html.startswith("->", lt + 4) else html.find("-->", lt + 4) + 2
            end = end if end > lt + 3 else size
        elif c in ("!", "?") or c == "/" and not _letter(html[lt + 2 : lt + 3]):
            end = html.find(">", lt)
            end = end if end >= 0 else size
        elif not (c == "/" or _letter(c)):
            look = lt + 1
            continue
        else:
            end = -1
        if end >= 0:
            add(html[at:lt])
            at = look = end + 1
            continue
        m = tags.match(html, lt)
        if not m and tags is TAG:  # from here on, quotes are letters
            tags = PLAIN_TAG
            m = tags.match(html, lt)
        if not m:
            if html.find(">", lt) < 0:  # the page ends inside a tag
                add(html[at:lt])
                at = size
                break
            look = lt + 1
            continue
        add(html[at:lt])
        at = m.end()
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            i = open_.last(tag)
            if i > 0 and (tag in BLOCK or i >= open_.walls[-1]):
                open_.close(i)
            elif tag == "p" and i < 0:
                open_.stack[-1].own.append(Node("br", [], open_.stack[-1], False))
            look = at
            continue
        if tag in ("html", "body"):
            if (i := open_.last("head")) > 0:
                open_.close(i)
            if tag == "html" or open_.last("body") > 0:
                look = at
                continue
        if tag in CLOSES_P and open_.stack[open_.blocks[-1]].tag == "p":
            open_.close(open_.blocks[-1])
        if tag in ENDS:
            which, bound = ENDS[tag]
            inner = [i for i in (open_.last(t) for t in which) if i > open_.last(*bound)]
            if inner:
                open_.close(min(inner))
        up = open_.stack[-1]
        attrs = _attrs(raw) if raw else {}
        node = Node(tag, _parts(f"{attrs.get('class', '')} {attrs.get('id', '')}"), up, _noise(tag, attrs, up))
        up.own.append(node)
        nodes.append(node)
        if tag in ("article", "main", "h1"):  # some sites put the whole page into a form
            for i in reversed(open_.at.get("form", ())):
                if not open_.stack[i].drop:
                    break
                open_.stack[i].drop = False
        if tag in RAW:
            stop = RAW_END[tag].search(html, at)
            stop = html.find(">", stop.start()) if stop else -1
            at = stop + 1 if stop >= 0 else size
        elif tag not in VOID and not (tag == "svg" and raw.rstrip().endswith("/")):
            open_.push(node)
        look = at
    add(html[at:])
    beside: dict[int, bool] = {}
    for n in nodes:
        if n.tag in SOFT:
            if id(n.up) not in beside:
                beside[id(n.up)] = any(isinstance(x, str) and not x.isspace() for x in n.up.own)
            n.drop = n.drop or not beside[id(n.up)]
    return nodes


def _measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        for x in n.own:
            if isinstance(x, str):
                n.text += len(" ".join(x.split()))
                n.commas += x.count(",") + x.count("，") + x.count("、")
            elif not x.drop:
                n.text, n.links, n.commas = n.text + x.text, n.links + x.links, n.commas + x.commas
        if n.tag == "a":
            n.links = n.text


def _density(n: Node) -> float:
    return n.links / n.text if n.text else 0.0


def _own_length(n: Node) -> tuple[int, int]:
    """Length and commas of the text that is not in an inner block."""
    size = commas = 0
    todo = [n]
    while todo:
        for x in todo.pop().own:
            if isinstance(x, str):
                size += len(" ".join(x.split()))
                commas += x.count(",") + x.count("，") + x.count("、")
            elif x.tag not in BLOCK and not x.drop:
                todo.append(x)
    return size, commas


def _score(nodes: list[Node], least: int) -> list[Node]:
    dropped: set[int] = set()
    found: list[Node] = []
    for n in nodes:
        if n.drop or (n.up and id(n.up) in dropped):
            dropped.add(id(n))
            continue
        if n.tag not in TEXTUAL or not n.up:
            continue
        size, commas = _own_length(n)
        if size < least:
            continue
        points = (1 + commas + min(size / 100, 3)) * (1 - _density(n))
        up, level = n.up if n.tag not in ("div", "section", "article", "main") else n, 0
        while up is not None and level < 4:
            if up.points is None:
                up.points = {"div": 5, "article": 10, "main": 10, "section": 3, "pre": 3, "td": 3, "blockquote": 3}.get(up.tag, 0) + (5 if any(x in GOOD for x in up.names) else 0)
                found.append(up)
            up.points += points / (1, 2, 6, 9)[level]
            up, level = up.up, level + 1
    return found


def _keeps(n: Node) -> bool:
    """Not a menu: outside of an article, a list or box of hardly more than links."""
    return not n.drop and (n.inside or not (n.tag in ("ul", "ol", "div", "section", "table", "dl") and n.text and _density(n) > 0.6))


def _render(roots: list[Node]) -> str:
    out: list[str] = []
    todo: list = list(reversed(roots))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif _keeps(x):
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.own))
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    _measure(nodes)
    found: list[Node] = []
    for least in (25, 1):
        found = _score(nodes, least)
        if found:
            break
    if not found:
        return _render(nodes[:1])
    for n in found:
        n.points *= 1 - _density(n)
    best = max(found, key=lambda n: n.points)
    # an article of which the winner is a part is the container
    up = best.up
    while up is not None:
        if up.tag in ("article", "main") and up.tag != best.tag and best.tag not in ("article", "main"):
            best = up
            break
        up = up.up
    if best.up is None:
        return _render([best])
    limit = max(10.0, 0.2 * (best.points or 0))
    keep = []
    for x in best.up.own:
        if isinstance(x, str) or x is best or (not x.drop and ((x.points or 0) >= limit or (x.tag in PROSE or x.tag not in BLOCK) and _density(x) < 0.25)):
            keep.append(x)
    return _render(keep)


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype="object")


def with_main_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    return pages.withColumn(name, F.pandas_udf(_texts, "string")(F.col(html)))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    out = with_main_text(pages.select("page_id", "url", "html"), name="_text")
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
