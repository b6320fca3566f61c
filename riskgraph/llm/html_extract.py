"""Main text of web pages by tree scoring.

The page is parsed into a tree without what is never content. Each paragraph
passes points for its length and commas to its parent and, halved, to the next
ancestors; a container's points are discounted by its link density. The best
container is kept, widened to the article or main element around it, with those
siblings, its own and its ancestors', that score well beside it. Beside a plain
container short paragraphs, bare text, lists and headings stay as well, beside an
article or main element only a heading that what is kept follows.

Elements that class, id or role name as page furniture are left out where they are
small or link-dense. One that holds half of the page's text is a wrapper and only
loses points, if its name may also mean something else (as "widget" or "header") or
if an article or main element is in it. Readers' comments are always left out.

Defined cases: null or empty html gives an empty text; unclosed and stray tags
are repaired as browsers do for paragraphs and list items; of containers with the
same points the one that begins first is the best; null ids pass through; repeated
rows are extracted independently; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame

from riskgraph.llm.rows import map_rows

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
#: Element names by role (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside button select option textarea input label "
    "fieldset iframe object embed svg canvas audio video map dialog menu math".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Start tag -> open elements that it ends, and those that stop the search.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
#: Words of class, id and role values that mark page furniture wherever they stand (fixed values).
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adslot sponsor sponsored promotion cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs masthead footer "
    "sidebar sidebars login pager pagination toolbar complementary contentinfo hidden skip".split()
)
#: Words that also name wrappers, and those of them that mark nothing where the name speaks of content as well (fixed values).
LOOSE = frozenset(
    "banner promo notice notification alert header aside rail widget related recommended share sharing social respond search".split()
)
VAGUE = frozenset("banner notice notification alert header aside rail widget respond search".split())
CONTENT = frozenset("article post entry content story text body main title heading headline".split())
#: Words that stand for reader comments, also on an article element (fixed values).
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Of the furniture, what also a paragraph or inline element can be (fixed values).
SMALL_PARTS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs hidden".split())
NAME = re.compile(r"[\s_-]+")
#: Link density from which named furniture is left out, and the share of the page's text from which it is a wrapper.
LINKED, WRAPS = 0.5, 0.5
#: Names that only say how a page is laid out, as in "no-sidebar" (fixed values).
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without|hide|show)[_-]\S*", re.I)
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>]))*+)>",
    re.S,
)
#: Where a tag begins that never ends.
OPENED = re.compile(r"<[a-zA-Z/!?]")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    __slots__ = ("name", "parent", "items", "drop", "suspect", "score", "text_len", "link_len")

    def __init__(self, name: str, parent: Node | None, drop: bool):
        self.name, self.parent, self.drop, self.suspect = name, parent, drop, ""
        self.items: list = []
        self.score = 0.0
        self.text_len = self.link_len = 0


def _hidden(raw: str) -> bool:
    for key, value in ATTR.findall(raw):
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value.strip("\"'") == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _furniture(name: str, raw: str) -> str:
    """What class, id or role name: "said" for readers' comments, "sure" or "loose" for furniture, or "".

    An article can only be the first.
    """
    if name in ("body", "html", "main"):
        return ""
    values = (LAYOUT.sub("", html_lib.unescape(v.strip("\"'"))) for k, v in ATTR.findall(raw) if k.lower() in ("class", "id", "role"))
    words = set(NAME.split(" ".join(values).lower()))
    if words & COMMENTS and not (words & CONTENT and words & COMMENTS == {"respond"}):
        return "said"
    if name == "article":
        return ""
    if name not in BLOCKS or name in PARAGRAPHS:
        return "sure" if words & SMALL_PARTS else ""
    if words & FURNITURE:
        return "sure"
    return "loose" if words & (LOOSE - VAGUE if words & CONTENT else LOOSE) else ""


def _settle(root: Node) -> None:
    """Drops suspects, except wrappers: those that hold half of the page's text, mostly not as links."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.items if isinstance(c, Node) and not c.drop)
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    holds: set[int] = set()
    for x in reversed(order):
        nodes = [c for c in x.items if isinstance(c, Node) and not c.drop]
        own = size[id(x)] = sum(len(c.strip()) for c in x.items if isinstance(c, str)) + sum(size[id(c)] for c in nodes)
        linked[id(x)] = own if x.name == "a" else sum(linked[id(c)] for c in nodes)
        if x.name in ("article", "main") and not x.suspect or any(id(c) in holds for c in nodes):
            holds.add(id(x))
    for x in order:
        if not x.suspect:
            continue
        big = size[id(x)] >= WRAPS * size[id(root)] and linked[id(x)] < LINKED * max(1, size[id(x)])
        if not big or x.suspect == "said" or x.suspect == "sure" and id(x) not in holds:
            x.drop = True


def parse(page: str) -> Node:
    """The page's tree; dropped elements are marked."""
    root = Node("#root", None, False)
    stack, at, size = [root], 0, len(page)

    def text(s: str) -> None:
        if s and not stack[-1].drop:
            stack[-1].items.append(html_lib.unescape(s) if "&" in s else s)

    def close(k: int) -> None:
        del stack[k:]

    end_of_tags = page.rfind(">") + 1  # what follows can't close a tag
    while at < size:
        m = TOKEN.search(page, at, end_of_tags) if at < end_of_tags else None
        if not m:
            text(OPENED.split(page[at:], maxsplit=1)[0])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                break
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name = m[2].lower()
        if m[1]:
            k = len(stack) - 1
            while k > 0 and stack[k].name != name:
                if stack[k].name in ("td", "th", "table", "article", "main", "body") and name not in BLOCKS:
                    k = 0  # an inline end tag doesn't close a container
                    break
                k -= 1
            if k > 0:
                close(k)
            elif name == "p" and not stack[-1].drop:
                stack[-1].items.append(Node("p", stack[-1], False))
            continue
        if name in CLOSES_P:
            k = len(stack) - 1
            while k > 0 and stack[k].name not in ("p", "td", "th", "button", "table", "div", "article", "section", "li", "body"):
                k -= 1
            if k > 0 and stack[k].name == "p":
                close(k)
        if name in ENDS:
            ends, stops = ENDS[name]
            k, found = len(stack) - 1, 0
            while k > 0 and stack[k].name not in stops:
                if stack[k].name in ends:
                    found = k
                k -= 1
            if found:
                close(found)
        top = stack[-1]
        node = Node(name, top, top.drop or name in DROPPED or bool(m[3]) and _hidden(m[3]))
        if not node.drop and m[3]:
            node.suspect = _furniture(name, m[3])
        if name == "form":
            node.suspect = node.suspect or "loose"
        top.items.append(node)
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
    _settle(root)
    return root


def blocks(node: Node) -> list[str]:
    """Text blocks of a subtree in page order, with single spaces."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        s = " ".join("".join(part).split())
        if s:
            out.append(s)
        part.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif not x.drop:
            if x.name == "br":
                part.append(" ")
                continue
            if x.name in BLOCKS or x is node:
                flush()
                todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def _measure(root: Node) -> list[Node]:
    """Elements in page order; text and link lengths bottom-up; paragraphs hand points to their ancestors."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in reversed(x.items) if isinstance(c, Node) and not c.drop)
    for x in reversed(order):
        commas = own = 0
        for c in x.items:
            if isinstance(c, str):
                own += len(c.strip())
                commas += c.count(",")
            elif not c.drop:
                x.text_len += c.text_len
                x.link_len += c.text_len if c.name == "a" else c.link_len
        x.text_len += own
        if x.name in PARAGRAPHS and x.text_len or own >= 25 and x.name in ("div", "section", "article", "main", "body"):
            points = 1 + commas + min(x.text_len // 100, 3)
            up, share = (x.parent, 1.0) if x.name in PARAGRAPHS else (x, 1.0)
            while up is not None and share >= 0.125:
                up.score += points * share
                up, share = up.parent, share / 2
    return order


def _density(x: Node) -> float:
    return x.link_len / x.text_len if x.text_len else 0.0


def _value(x: Node) -> float:
    """Points after the discounts for links and for a furniture name."""
    return x.score * (1 - _density(x)) * (0.5 if x.suspect else 1.0)


def _stays(c: Node, limit: float, plain: bool) -> bool:
    """Whether a block beside the kept subtree is kept; ``plain`` where that is no article or main."""
    if not c.text_len or _density(c) >= 0.25:
        return False
    if c.name in ("div", "section", "article", "main", "table", "center"):
        return _value(c) >= limit
    return plain


def _run(items: list) -> list[str]:
    """The block that bare text and inline elements side by side make, unless half of it are links."""
    whole = Node("#run", None, False)
    whole.items = items
    links = sum(c.text_len if c.name == "a" else c.link_len for c in items if isinstance(c, Node))
    size = sum(len(c.strip()) if isinstance(c, str) else c.text_len for c in items)
    return blocks(whole) if 2 * links < size else []


def _beside(kept: Node, limit: float, plain: bool) -> tuple[list[str], list[str]]:
    """Blocks before and after ``kept`` among its siblings that are kept with it."""
    out: list[str] = []
    before: list[str] = []
    heads: list[str] = []  # headings that nothing kept follows yet
    run: list = []

    def flush() -> None:
        nonlocal heads
        if run and plain and (found := _run(list(run))):
            out.extend(heads + found)
            heads = []
        run.clear()

    for c in [*kept.parent.items, None]:
        if isinstance(c, str) or c is not None and c is not kept and c.name not in BLOCKS:
            if isinstance(c, str) or not c.drop:
                run.append(c)
            continue
        flush()
        if c is None:
            break
        if c is kept:
            before, out, heads = out + heads, [], []
        elif not c.drop and c.name in HEADINGS and _density(c) < 0.25:
            heads += blocks(c)
        elif not c.drop and _stays(c, limit, plain):
            out += heads + blocks(c)
            heads = []
    return before, out + heads if plain else out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    best = max((x for x in order if x.name not in PARAGRAPHS), key=_value, default=root)
    if _value(best) <= 0:
        best = root
    limit = 0.2 * _value(best)
    kept, up = best, best
    while up is not None:
        if up.name in ("article", "main"):
            kept = up
        up = up.parent
    plain = kept.name not in ("article", "main")
    out = blocks(kept)
    while kept.parent is not None:
        before, after = _beside(kept, limit, plain)
        out = before + out + after
        kept, plain = kept.parent, False
    return "\n\n".join(out)


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; one pass, no shuffle."""

    def factory():
        def one(i, url, page):
            t = main_text(page)
            return i, url, t, len(t)

        return one

    return map_rows(pages, [id_col, url_col, html_col], factory, SCHEMA)
