"""Main text of web pages by tree scoring.

Markup becomes a tree; blocks of running text pass points for length and commas to their
ancestors, less for distant ones, discounted by the share of linked text. The best
container and the siblings that score alike are kept, without the parts that are never text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_GAP = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[^a-z0-9]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript", "template"}
_VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
_NEVER = _RAW | set("head nav footer aside button select option svg math canvas object audio video map dialog menu "
                    "datalist label input".split())
_BLOCK = set("address article blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 "
             "h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th "
             "thead tr ul aside".split())
# words of class, id and role names that mark what is not the article
_AWAY = set("ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
            "commentlist consent cookie cookies disqus dropdown footer gdpr hidden masthead menu menubar modal nav navbar "
            "navigation newsletter notice notification outbrain pager pagination popup promo promoted promotion recommended "
            "related remark replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
            "subscribe subscription taboola toolbar widget complementary contentinfo alert alertdialog".split())
# parts that may stand beside them in one name; any other part ("no-sidebar", "related-work") makes another name
_PLAIN = set("area bar block bottom box container inner item items left list outer right section top widgets wrap "
             "wrapper".split())
_BOXES = {"form", "fieldset"}  # go like named boxes
_GOOD = set("article body content entry main post story text page prose".split())
_CLOSES_P = _BLOCK - {"body", "html", "tbody", "td", "th", "tr", "thead", "tfoot"}
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
# elements that can be the container; lists, rows and paragraphs pass their points on
_HOLDS = set("div section article main body html td center details dd".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup"}
_MENUS = {"ul", "ol", "div", "table", "section", "dl"}  # left out if most of their text is links
_PROSE = {"p", "ul", "ol", "dl", "pre", "blockquote", "table", "figure", "address"}
_SCOPE = {"table", "td", "th", "caption", "button", "object", "body", "html"}  # an open p beyond these stays open


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "score", "names", "aside")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.score = 0.0
        self.aside = 0  # boxes around it, or itself, whose names tell them from the article
        self.names = set(_NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".lower()))


def parse(html: str) -> Node:
    """A tolerant tree: optional end tags are implied, unknown ends ignored, raw text kept out."""
    root = Node("html", {}, None)
    stack, at, low = [root], 0, None

    def close(tags: set[str], stops: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while True:
        m = _TOKEN.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text:
            stack[-1].items.append(unescape(text))
        if not m:
            return root
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].items.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue  # whatever follows still belongs there
            if tag == "p" and not any(n.tag == "p" for n in stack):
                continue
            close({tag}, {"body", "table"} if tag not in ("table", "body") else {"body"})
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in _SIBLING:
            tags, stops = _SIBLING[tag]
            if tag == "tr":
                close({"td", "th"}, {"table"})
                tags = {"tr"}
            close(tags, stops)
        if tag == "body" and any(n.tag == "body" for n in stack):
            continue
        if tag == "body":
            del stack[1:]
        attrs = {}
        if m[3].strip(" /\n\t"):
            for k, v in _ATTR.findall(m[3]):
                attrs.setdefault(k.lower(), v.strip("\"'"))
        node = Node(tag, attrs, stack[-1])
        stack[-1].items.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            if low is None:
                low = html.lower() if len(html.lower()) == len(html) else html
            end = low.find(f"</{tag}", at)
            if end < 0:
                return root
            at = html.find(">", end) + 1 or len(html)
            continue
        stack.append(node)


def _away(n: Node) -> bool:
    if n.tag in _NEVER or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return True
    style = n.attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    if n.tag == "header":  # a page's header goes, an article's own stays
        up = n.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    return False


def _named_away(n: Node) -> bool:
    """Whether a whole class, id or role says that a box is not the article."""
    if n.tag in ("html", "body", "article", "main"):
        return False
    if n.tag in _BOXES:
        return True
    if not n.names & _AWAY:
        return False
    for token in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')} {n.attrs.get('role', '')}".lower().split():
        parts = {x for x in _PARTS.split(token) if x and not x.isdigit()}
        if parts & _AWAY and parts <= _AWAY | _PLAIN:
            return True
    return False


def _prune(root: Node) -> list[Node]:
    """Takes out what is never text; the boxes that their names tell from the article, in page order."""
    named = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n is not root and _named_away(n):
            named.append(n)
        n.items = [x for x in n.items if isinstance(x, str) or not _away(x)]
        todo += [x for x in reversed(n.items) if not isinstance(x, str)]
    return named


def _mark(root: Node, named: set[int]) -> None:
    todo = [root]
    while todo:
        n = todo.pop()
        n.score = 0.0
        n.aside = (n.parent.aside if n is not root else 0) + (id(n) in named)
        todo += [x for x in n.items if not isinstance(x, str)]


class _Block:
    __slots__ = ("owner", "parts", "linked")

    def __init__(self, owner: Node) -> None:
        self.owner, self.parts, self.linked = owner, [], 0


def blocks(top: Node) -> list[_Block]:
    """Runs of inline text between block boundaries, in page order, each with the element that holds it."""
    out, cur = [], _Block(top)
    # walk without recursion: (node or text, owner, inside a link, leaving)
    todo: list[tuple] = [(top, top, False, False)]
    while todo:
        x, owner, link, leaving = todo.pop()
        if leaving:
            out.append(cur)
            cur = _Block(owner)
        elif isinstance(x, str):
            cur.parts.append(x)
            if link:
                cur.linked += len(x.strip())
        elif x.tag == "br":
            cur.parts.append("\n")
        else:
            inner = owner
            if x.tag in _BLOCK:
                out.append(cur)
                cur, inner = _Block(x), x
                todo.append((None, owner, link, True))
            for y in reversed(x.items):
                todo.append((y, inner, link or x.tag == "a", False))
    out.append(cur)
    return [b for b in out if any(p.strip() for p in b.parts)]


def _text(b: _Block) -> str:
    return _GAP.sub(" ", "".join(b.parts)).strip()


def _within(n: Node | None, top: set[int]) -> bool:
    while n is not None:
        if id(n) in top:
            return True
        n = n.parent
    return False


def _weigh(root: Node) -> tuple[list[tuple[_Block, str]], dict[int, int], dict[int, int], dict[int, Node]]:
    """The text blocks, characters and linked characters below each element, and the containers with their points."""
    found = [(b, _text(b)) for b in blocks(root)]
    chars: dict[int, int] = {}
    linked: dict[int, int] = {}
    scored: dict[int, Node] = {}
    for b, text in found:
        points = (1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100.0, 3.0)) * min(1.0, len(text) / 25.0)
        if b.owner.tag in ("li", "th", "dt", "h1", "h2", "h3", "h4", "h5", "h6"):
            points *= 0.25
        points *= 0.25 ** min(b.owner.aside, 50)  # a name is a penalty
        # full points for the nearest container, half for the next, a quarter, a sixth; a cell of
        # a data table is none
        n, step = b.owner.parent if b.owner.tag in ("td", "dd") else b.owner, 0
        while n is not None:
            if n.tag in _HOLDS:
                n.score += points / max(1, 2 * step)
                scored[id(n)] = n
                step += 1
            n = n.parent
        n = b.owner
        while n is not None:
            chars[id(n)] = chars.get(id(n), 0) + len(text)
            linked[id(n)] = linked.get(id(n), 0) + b.linked
            n = n.parent
    return found, chars, linked, scored


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by an empty line; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    named = _prune(root)
    _mark(root, {id(n) for n in named})
    found, chars, linked, scored = _weigh(root)

    def density(n: Node) -> float:
        return linked.get(id(n), 0) / max(1, chars.get(id(n), 0))

    def value(n: Node) -> float:
        extra = 25.0 if n.tag in ("article", "main") else 5.0 if n.tag in ("div", "section") else 0.0
        if n.names & _GOOD:
            extra += 10.0
        return (n.score + extra * min(1.0, n.score / 3.0 + 0.2)) * (1.0 - min(1.0, density(n)))

    if not scored:
        return ""
    best = max(scored.values(), key=value)  # ties: the first met, which lies deepest
    if named:
        # a named box goes unless it holds the best container or the larger part of the unlinked text
        path, n = set(), best
        while n is not None:
            path.add(id(n))
            n = n.parent
        plain = {id(n): chars.get(id(n), 0) - linked.get(id(n), 0) for n in [root, *named]}
        gone = {id(n) for n in named if id(n) not in path and 2 * plain[id(n)] <= plain[id(root)]}
        for up in {id(n.parent): n.parent for n in named}.values():
            up.items = [x for x in up.items if isinstance(x, str) or id(x) not in gone]
        _mark(root, {id(n) for n in named} - path)
        found, chars, linked, scored = _weigh(root)
        best = max(scored.values(), key=value)
    floor = 0.2 * value(best)
    keep = {id(best)}
    if best.parent is not None:
        near = [s for s in best.parent.items if not isinstance(s, str) and (s is best or chars.get(id(s), 0))]
        for s in near:
            if s is best or s.aside > best.aside:
                continue
            size = chars.get(id(s), 0)
            like = value(s) + (0.2 * value(best) if s.names and s.names == best.names else 0.0) >= floor and s.score > 0
            # what is no container has no points: its own text and links decide; a heading goes with what follows
            prose = s.tag in _PROSE and (size > 80 and density(s) < 0.25 or 0 < size <= 80 and linked.get(id(s), 0) == 0
                                         and best.tag not in ("article", "main"))
            if (like and best.tag != "article") or (like and s.tag == best.tag) or prose:
                keep.add(id(s))
        at = [i for i, s in enumerate(near) if id(s) in keep]
        first, last = at[0], at[-1]
        while first > 0 and near[first - 1].tag in _HEADINGS and near[first - 1].aside <= best.aside:
            first -= 1
        # nothing between two parts of the article is left out but lists and boxes of links
        keep |= {id(s) for s in near[first:last] if s.aside <= best.aside and (s.tag not in _MENUS or density(s) <= 0.6)}

    # bare text of the parent between two kept parts stays as well
    held = [i for i, (b, _) in enumerate(found) if _within(b.owner, keep)]
    loose = {i for i in range(held[0], held[-1]) if found[i][0].owner is best.parent
             and found[i][0].linked <= 0.6 * len(found[i][1])} if held else set()
    out = []
    for i in sorted({*held, *loose}):
        b, text = found[i]
        if i in loose:
            out.append(text)
            continue
        n, menu = b.owner, False
        while n is not None and id(n) not in keep:  # lists and boxes of links inside the container
            if n.tag in _MENUS and density(n) > 0.6 and chars.get(id(n), 0) > 0:
                menu = True
            n = n.parent
        if not menu:
            out.append(text)
    return "\n\n".join(out)


def extract(html: Column) -> Column:
    """Main text of a column of pages, in Arrow batches."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in pages], dtype=object)

    return run(html)


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out_col`` (replaced if it exists) instead of the markup.

    Null and empty pages give an empty text, as do pages without running text. Character
    references are decoded, white space inside a block becomes one space, blocks follow in
    page order with an empty line between; nothing is cut. Repeated rows and other columns
    pass through; an empty table stays empty. One narrow pass, no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, out_col)]
    return pages.select(*kept, extract(F.col(html_col)).alias(out_col))
