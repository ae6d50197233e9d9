"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: A comment, a tag, or a declaration. Quantifiers are possessive, so no input makes matching slow.
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe button select option svg math canvas object audio video dialog head title textarea menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body figcaption h1 h2 h3 h4 h5 h6 dt th caption summary address center".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table td th ul ol dl article main section div aside nav header footer form".split())
#: Never left out for their names, as they hold whole pages.
WHOLE = frozenset("html body main".split())
#: Names for which an ``article`` is left out; other side words may tell of its layout or its tags.
REPLY_WORDS = frozenset("comment comments commentlist disqus related replies reply respond".split())
#: Words in class and id that mark what isn't the article.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
#: Words before a side word that make it a trait of a layout: ``with-sidebar`` isn't a sidebar.
TRAITS = frozenset("with without has no show hide open is in".split())
#: Their names say nothing about the page: headings of the article, and code, whose parts are often called comments.
NAMELESS = frozenset("h1 h2 h3 h4 h5 h6 pre code kbd samp".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Ancestors that a paragraph's points reach.
MOST_LEVELS = 64
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "score", "chars", "linked", "out", "points", "code")

    def __init__(self, tag: str, parent: "Node | None", out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.code = tag in NAMELESS or parent is not None and parent.code
        self.score = self.points = 0.0
        self.chars = self.linked = 0


def side_name(tag: str, names: str) -> bool:
    """Whether any class or id holds a side word, but for one that follows a word of ``TRAITS``."""
    if tag in WHOLE:
        return False
    words = REPLY_WORDS if tag == "article" else SIDE_WORDS
    for name in names.split():
        before = ""
        for part in NAME_PARTS.findall(name):
            part = part.lower()
            if part in words and before not in TRAITS:
                return True
            before = part
    return False


def marked_side(tag: str, attributes: str, nameless: bool = False) -> bool:
    """Whether attributes say that an element isn't part of the article."""
    if not attributes or attributes.isspace():
        return False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in (style := found.get("style", "").lower().replace(" ", "")) or "visibility:hidden" in style:
        return True
    if tag in WHOLE:
        return False
    if found.get("role", "").lower() in SIDE_ROLES:
        return True
    return not nameless and side_name(tag, f"{found.get('class', '')} {found.get('id', '')}")


def blocks(html: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The blocks of a page in order, as (block element, text), without what is left out; and all elements.

    Each text run belongs to the nearest block element; a new block starts wherever a block element
    starts or ends and at line breaks. Unclosed and misnested tags are closed as browsers do: a block
    start ends an open paragraph, an end tag ends what is open inside its element.
    """
    root = Node("html", None, False)
    stack, nodes = [root], [root]
    done: list[tuple[Node, str]] = []
    held: list[str] = []
    owner = root
    linked = 0

    def flush():
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                done.append((owner, text))
                owner.linked += min(linked, len(text))
            held, linked = [], 0

    # Places in the stack of open elements by tag, of open blocks and of open scopes, so that no tag searches the stack.
    places: dict[str, list[int]] = {}
    open_blocks, scopes, outer_scopes = [], [], []

    def last(of: list[int] | None) -> int:
        return of[-1] if of else 0

    def push(node: Node):
        k = len(stack)
        stack.append(node)
        nodes.append(node)
        places.setdefault(node.tag, []).append(k)
        if node.tag in BLOCKS:
            open_blocks.append(k)
        if node.tag in SCOPES:
            scopes.append(k)
            if node.tag not in ("td", "th"):
                outer_scopes.append(k)

    def close(at: int):
        """End the open elements from ``at`` on."""
        nonlocal owner
        if last(open_blocks) >= at:
            flush()
        for n in stack[at:]:
            places[n.tag].pop()
        del stack[at:]
        for of in (open_blocks, scopes, outer_scopes):
            while of and of[-1] >= at:
                of.pop()
        owner = stack[last(open_blocks)]

    at, end = 0, len(html)
    in_link = 0
    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].out:
            piece = html[at:stop]
            held.append(unescape(piece) if "&" in piece else piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            k = last(places.get(tag))
            if k and (tag in BLOCKS or last(open_blocks) < k):
                close(k)
            if tag == "p":
                flush()
            in_link = len(places.get("a", ()))
            continue
        if tag == "br" or tag == "hr":
            flush() if tag == "hr" else held.append(" ") if not stack[-1].out else None
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            k = last(places.get("p"))
            if k and k > last(scopes):
                close(k)
            k = max((last(places.get(t)) for t in CLOSED_BY.get(tag, ())), default=0)
            if k and k >= last(outer_scopes):
                close(k)
            flush()
        node = Node(tag, stack[-1], stack[-1].out or tag in LEFT_OUT)
        node.out = node.out or marked_side(tag, m[3], node.code)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = closing.start() if closing else end
            if closing:
                at = html.find(">", closing.end() - 1)
                at = end if at < 0 else at + 1
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        push(node)
        if tag == "a":
            in_link += 1
        if tag in BLOCKS:
            owner = node
    flush()
    return done, nodes


def main_text(html) -> str:
    """The article of a page: blocks joined by a space; empty if there is none.

    Each paragraph gives points: one, one for each comma, and up to three for its length. They pass to
    its parent in full, to the grandparent by half, to further ancestors (64 in all) by less, and count less the more of
    an ancestor's text is linked. The container of the most points is the article, or the whole ``article`` or
    ``main`` element around it, or one inside that holds most of it; siblings join if they have enough points of their own.
    """
    if not html:
        return ""
    found, nodes = blocks(html)
    if not found:
        return ""
    for node, text in found:
        points = 1.0 + text.count(",") + min(len(text) // 100, 3)
        node.points += points
        node.chars += len(text)
        # A paragraph's own element is a candidate only if it is more than a paragraph.
        up = node if node.tag in ("div", "section", "article", "main", "body", "td", "html") else node.parent
        share, level = 1.0, 1
        while up is not None and level <= MOST_LEVELS:
            up.score += points * share
            level += 1
            share = 1.0 / (2 * (level - 1)) if level > 1 else 1.0
            up = up.parent
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.linked += n.linked
            n.parent.chars += n.chars

    def value(n: Node) -> float:
        return n.score * (1.0 - n.linked / n.chars) if n.chars else 0.0

    best = max((n for n in nodes if not n.out and n.chars and n.tag not in ("p", "a", "li")), key=lambda n: (value(n), n.tag in ("article", "main")), default=None)
    if best is None:
        return ""
    # The article or main element around the best container is whole; one beside or inside of it stands in for it only if it
    # scores as much itself, or if it holds most of its text. A teaser or a short quote of another page does neither.
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.out and n.chars]
    known = {id(n) for n in articles}
    around, n = None, best
    while n is not None and around is None:
        around = n if id(n) in known else None
        n = n.parent
    if around is None:
        around = max((a for a in articles if value(a) >= 0.5 * value(best) or a.chars >= 0.5 * best.chars), key=value, default=None)
    top = around or best
    chosen = {id(top)}
    least = max(10.0, 0.2 * value(top))
    for n in nodes:
        if n.parent is top.parent and n is not top and not n.out and top.parent is not None:
            own = n.chars and n.linked / n.chars
            if (n.tag == top.tag or n.tag in ("div", "section", "article")) and value(n) >= least or n.tag == "p" and n.chars > 80 and own < 0.25 and around is None:
                chosen.add(id(n))

    for n in nodes:  # parents come before their children
        if n.parent is not None and id(n.parent) in chosen:
            chosen.add(id(n))
    return " ".join(text for node, text in found if id(node) in chosen)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points).

    Null and empty html give an empty text, and so does a page without any block outside of what is left
    out. Repeated rows give a row each; other columns are left alone, and an empty table gives no rows. Whole
    pages are parsed, very long ones too; containers of equal scores: an ``article`` or ``main`` first, then the first.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html").mapInArrow(parse, "page_id long, url string, text string, n_chars long")
