"""Main text of web pages by tree scoring.

A page is read into a light tree (tags left open are closed as browsers do for paragraphs, list items and table cells) in time in
proportion to its length.  Parts that are furniture by their tag, role or class name (menus, page headers and footers, sidebars, notices,
adverts, forms, reader comments) count for nothing.  A furniture element that is never closed is one up to its first heading, paragraph or
container only.  A form, and an element that only a word of its class which articles use too makes furniture, is none if it holds at least half of the page's text
outside links.  An article's own header is none, nor is an inline element within a sentence, whatever its class.

Each paragraph passes points for its length and its commas to its ancestors, half to the grandparent and less further up; a container's points are
discounted by its link density.  The best container is kept with those siblings that score a fifth of it or read like text, and all that
stands between them: sections beside a section and parts of one class count as text however short they are.  An article around the best container is kept
whole, with the other articles beside it; a main element is kept whole; a first-level heading before them belongs to them.  Lists and tables of links only
are left out before and after the text, not within it, nor where a heading that speaks of sources or the like announces them.
The blocks are the result, white space folded, a line each.

Defined cases: null or empty html, or no text outside furniture, gives an empty text; repeated rows give a row each;
other columns are ignored; nothing is cut however long a page is.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
FURNITURE = frozenset("nav header footer aside form button select option input label dialog menu fieldset audio video head".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Class words of furniture.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|cookie\w*|consent|gdpr|side-?bar|side-?rail|(?:left|right)-?(?:side|rail)|comments?|commentlist|respond|disqus|replies|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|site-?footer|site-?header|page-?header|masthead|topbar|newsletter|subscri\w*|signup|login|pagination|pager|toolbar|hidden)(?:$|[\s_-])",
    re.I,
)
#: Class words that articles bear too.
UNCERTAIN = re.compile(r"(?:^|[\s_-])(?:tags|legal|copyright|disclaimer|related|recommend\w*|share|sharing|social|promo\w*|sponsor\w*|notices?|alert|banner|header|widget|toc|skip|modal|popup|overlay|print-?only)(?:$|[\s_-])", re.I)
OWN_HEADER = re.compile(r"(?:^|[\s_-])(?:entry|post|article|story|content)[\s_-]*(?:header|title|head)(?:$|[\s_-])", re.I)
#: Headings of lists of links that are no part of a text.
ELSEWHERE = re.compile(r"related|more|read next|recommend|popular|trending|latest|share|follow|tags|categories|archive|navigation|menu|links?$", re.I)
KEEP = frozenset("html body article main".split())

TEXT = re.compile(r"[^<]+")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
VALUE = re.compile(r"=\s*\Z")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


class Node:
    __slots__ = ("tag", "parent", "kids", "score", "marked", "chars", "linked", "dropped", "closed", "unsure", "name", "mass")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, unsure: bool = False, name: str = ""):
        self.tag, self.parent, self.kids, self.score, self.marked, self.chars, self.linked, self.dropped, self.closed = tag, parent, [], 0.0, False, 0, 0, dropped, False
        self.unsure, self.name, self.mass = unsure, name, 0  # furniture unless it holds half of the text; its class; its text outside links


NO, UNSURE, YES = range(3)


def furniture(tag: str, attributes: str, in_article: bool = False, in_sentence: bool = False) -> int:
    """Whether an element is furniture: no, by a word that articles bear too (or as a form), or yes."""
    if tag in FURNITURE and not (tag == "header" and in_article):
        return UNSURE if tag == "form" else YES
    if not attributes or attributes.isspace() or tag in KEEP and "hidden" not in attributes:
        return NO
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return YES
    if found.get("role", "").lower() in ROLES:
        return YES
    if tag in KEEP or in_sentence and tag not in BLOCK:
        return NO
    out = NO
    for k in ("class", "id"):
        words = re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get(k, ""))
        if not OWN_HEADER.search(words):
            out = max(out, YES if UNLIKELY.search(words) else UNSURE if UNCERTAIN.search(words) else NO)
    return out


def class_of(attributes: str) -> str:
    m = re.search(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", attributes) if "class" in attributes else None
    return (m[1] or m[2] or m[3] or "").strip() if m else ""


def tag_end(page: str, pos: int) -> int:
    """Where the tag ends whose name ends at pos, its ">" included, or -1.  A quote counts after "=" only; one that is never closed ends with the tag."""
    while m := MARK.search(page, pos):
        if m[0] == ">":
            return m.end()
        pos = m.end()
        if VALUE.search(page, max(0, m.start() - 64), m.start()):
            at = page.find(m[0], pos)
            if at < 0:
                return page.find(">", pos) + 1 or -1
            pos = at + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", "") or ("", tag, attributes); the tag begins with "/" if it closes one.  Comments, declarations and raw elements are left out."""
    pos, n = 0, len(page)
    while pos < n:
        if m := TEXT.match(page, pos):
            pos = m.end()
            yield m[0], "", ""
        elif page.startswith(("<!--", "<![CDATA["), pos):
            data = page.startswith("<![", pos)
            start, stop = pos + (9 if data else 4), "]]>" if data else "-->"
            end = page.find(stop, start)
            end = n if end < 0 else end
            if data:
                yield entities.escape(page[start:end], quote=False), "", ""
            pos = end + 3
        elif page.startswith(("<!", "<?"), pos):
            pos = page.find(">", pos) + 1 or n
        elif m := NAME.match(page, pos):
            end = tag_end(page, m.end())
            if end < 0:  # no tag ends any more: all the rest is text
                yield page[pos:], "", ""
                return
            tag, attributes, closes = m[1].lower(), page[m.end() : end - 1], page[pos + 1] == "/"
            pos = end
            if tag in RAW and not closes:
                if not attributes.endswith("/") or tag not in ("svg", "math"):
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
                    pos = page.find(">", found.end()) + 1 or n if found else n
            elif not closes or tag not in RAW:
                yield "", "/" * closes + tag, attributes
        else:
            pos += 1
            yield "<", "", ""


#: A furniture element left open ends where one of these begins.
RESUMES = frozenset("article main section div p h1 h2 h3 h4 h5 h6".split())


def parse(page: str) -> Node:
    """The tree of a page; text stands among the kids, furniture is marked as dropped."""
    root = node = Node("html", None)
    opened: dict[str, int] = {}
    fixtures: list[Node] = []

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    for text, tag, attributes in tokens(page):
        if text:
            node.kids.append(text)
        elif tag[0] != "/":
            if tag in ("html", "body"):
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    node.kids.append(Node(tag, node))
                continue
            if tag in BLOCK and opened.get("p"):  # an open paragraph ends where a block begins
                at = node
                while at is not root and at.tag != "p" and at.tag not in BLOCK:
                    at = at.parent
                if at.tag == "p":
                    leave(at.parent)
            if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag]):
                at, close = node, None
                while at is not root and at.tag not in STOPS[tag]:
                    if at.tag in CLOSES[tag]:
                        close = at
                    at = at.parent
                if close is not None:
                    leave(close.parent)
            kind = furniture(tag, attributes, bool(opened.get("article") or opened.get("main")), any(opened.get(x) for x in SENTENCES))
            kid = Node(tag, node, kind > NO, kind == UNSURE, class_of(attributes))
            node.kids.append(kid)
            if kid.dropped:
                fixtures.append(kid)
            if attributes.endswith("/") and (kid.dropped or tag not in BLOCK):
                kid.closed = True
            else:
                node = kid
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag[1:]):
            tag, at = tag[1:], node
            while at is not root and at.tag != tag:
                if tag not in BLOCK and tag not in FURNITURE and at.tag in BLOCK:
                    break
                at = at.parent
            if at is not root and at.tag == tag:
                at.closed = True
                leave(at.parent)
    whole = weigh(root) if fixtures else 0
    for at in fixtures:
        if at.unsure and at.mass and 2 * at.mass >= whole:
            at.tag, at.dropped = "div" if at.tag == "form" else at.tag, False
        elif not at.closed and at.tag not in ("option", "input", "label", "button", "head"):
            first = next((i for i, k in enumerate(at.kids) if not isinstance(k, str) and k.tag in RESUMES and not k.dropped), len(at.kids))
            at.tag, at.dropped, at.kids = "div", False, at.kids[first:]
    return root


#: Elements whose inline parts belong to a sentence.
SENTENCES = ("p", "li", "dd", "td", "th", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "pre")


def weigh(root: Node) -> int:
    """Set every node's mass: the characters of its text outside links and sure furniture.  The mass of the root."""
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [k for k in at.kids if not isinstance(k, str)]
    for at in reversed(order):
        at.mass = sum(len(k) if isinstance(k, str) and not k.isspace() else 0 if isinstance(k, str) or k.tag == "a" or k.dropped and not k.unsure else k.mass for k in at.kids)
    return root.mass


def own_text(node: Node) -> str:
    """A node's text without that of blocks inside it."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        elif at is not node and (at.dropped or at.tag == "br" or at.tag in BLOCK):
            out.append(" ")
        else:
            stack += reversed(at.kids)
    return "".join(out)


def measure(root: Node) -> list[Node]:
    """Characters and linked characters of every node; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [k for k in reversed(at.kids) if not isinstance(k, str) and not k.dropped]
    for at in reversed(order):
        own = sum(len(" ".join(k.split())) for k in at.kids if isinstance(k, str))
        inner = [k for k in at.kids if not isinstance(k, str) and not k.dropped]
        at.chars = own + sum(k.chars for k in inner)
        at.linked = at.chars if at.tag == "a" else sum(k.linked for k in inner)
    return order


def only_links(node: Node) -> bool:
    return node.tag in ("ul", "ol", "table", "dl") and node.chars > 0 and node.linked > 0.8 * node.chars


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below nodes, in page order; lists of links before the first text or heading and after the last text are menus, but for those
    that a heading, or a paragraph that ends with a colon, announces."""
    out: list[tuple[str, bool]] = []  # a block's text, whether it stands in a menu
    announced = ""
    held: list[str] = []
    depth = heading = 0

    def flush() -> None:
        nonlocal announced
        if held and (text := " ".join(entities.unescape("".join(held)).split())):
            out.append((text, depth > 0))
            announced = text if heading or text.endswith((":", "：")) else ""
        held.clear()

    stack: list = [iter(nodes)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, str):
            held.append(kid)
        elif kid == 0:
            flush()
        elif kid in (1, 2):
            flush()
            depth -= kid == 1
            heading -= kid == 2
        elif kid.dropped:
            if kid.tag in BLOCK:
                flush()
            else:
                held.append(" ")
        elif kid.tag == "br":
            held.append(" ")
        elif kid.tag in BLOCK or kid.tag == "hr":
            flush()
            menu = only_links(kid) and not (announced and not ELSEWHERE.search(announced))
            title = not menu and kid.tag in HEADINGS
            depth += menu
            heading += title
            stack.append(iter([*kid.kids, 1 if menu else 2 if title else 0]))
        else:
            stack.append(iter(kid.kids))
    flush()
    plain = [i for i, (_, menu) in enumerate(out) if not menu]
    return [text for text, _ in out[plain[0] : plain[-1] + 1]] if plain else []


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def around(node: Node, tag: str) -> Node | None:
    """The outermost element of a tag that holds the node, itself included."""
    found = None
    while node is not None:
        found, node = node if node.tag == tag else found, node.parent
    return found


def with_heading(nodes: list[Node], order: list[Node]) -> list[Node]:
    """The nodes, after the last first-level heading before them if they hold none themselves."""
    stack, first = list(nodes), nodes[0]
    while stack:
        at = stack.pop()
        if isinstance(at, str) or at.dropped:
            continue
        if at.tag == "h1":
            return nodes
        stack += at.kids
    title = None
    for at in order:
        if at is first:
            break
        if at.tag == "h1" and at.chars and density(at) < 0.5:
            title = at
    return [title, *nodes] if title is not None else nodes


def articles_beside(article: Node) -> list[Node]:
    """An article and those beside it: of one parent, or each alone in a wrapper of one class."""
    good = lambda x: x.tag == "article" and not x.dropped and x.chars and density(x) < 0.5
    parent = article.parent
    if parent is None:
        return [article]
    beside = [k for k in parent.kids if not isinstance(k, str) and (k is article or good(k))]
    if len(beside) == 1 and parent.parent is not None and parent.tag not in KEEP:
        wraps = [k for k in parent.parent.kids if not isinstance(k, str) and not k.dropped and k.tag == parent.tag and k.name == parent.name]
        inner = [(w, [k for k in w.kids if not isinstance(k, str) and k.tag == "article"]) for w in wraps]
        beside = [x[0] for w, x in inner if x and (w is parent or len(x) == 1 and good(x[0]))]
    return beside


def best_container(root: Node) -> list[Node]:
    """The nodes that hold the text, in page order."""
    order = measure(root)
    best = best_scored(order)
    if best is None:  # only short pieces: an article or main element, else all that isn't furniture
        inner = [x for x in order if x.tag in ("article", "main") and x.chars]
        return with_heading([max(inner, key=lambda x: x.chars)], order) if inner else [root]
    if (article := around(best, "article")) is not None:
        return with_heading(articles_beside(article), order)
    if (main := around(best, "main")) is not None or best.parent is None:
        return with_heading([main or best], order)
    return with_heading(with_siblings(best), order)


def best_scored(order: list[Node]) -> Node | None:
    """The container with the most points, the first of equals; its siblings' points stand in them."""
    scored: list[Node] = []
    for at in order:
        if at.tag not in ("p", "td", "pre", "blockquote", "div", "li", "dd", "section", "article", "main", "html"):
            continue
        text = " ".join(own_text(at).split())
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)
        up, level = (at if at.tag in ("html", "article", "main") else at.parent), 0
        while up is not None and level < 5:
            if not up.marked:
                up.marked = True
                scored.append(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    for at in scored:
        at.score *= 1 - density(at)
    return max(scored, key=lambda x: x.score, default=None)


def with_siblings(best: Node) -> list[Node]:
    kids = [k for k in best.parent.kids if not isinstance(k, str) and not k.dropped]
    kept = []
    for i, kid in enumerate(kids):
        short = " ".join(own_text(kid).split()) if kid.tag == "p" else ""
        reads = kid.tag == "p" and (kid.chars > 80 and density(kid) < 0.25 or 0 < kid.chars <= 80 and density(kid) == 0 and bool(SENTENCE.search(short)))
        alike = kid.chars and density(kid) < 0.3 and kid.tag == best.tag and (kid.tag == "section" or kid.name and kid.name == best.name)
        if kid is best or kid.marked and kid.score >= max(10, 0.2 * best.score) or reads or alike or kid.tag in ("h1", "h2", "h3") and density(kid) < 0.3:
            kept.append(i)
    return kids[kept[0] : kept[-1] + 1]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(best_container(parse(page))))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
