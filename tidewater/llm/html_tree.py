"""One page's elements in one pass over its source: texts of blocks, and a hash of each block element's subtree.

Not a browser's tree: inline elements only matter where they are left out, and end tags that browsers
add by themselves are added for paragraphs, headings, list items and table cells.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

# Names of HTML elements, and names that sites give to what isn't article.
BLOCK = frozenset("""address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Left out wherever they stand.
LEFT_OUT = frozenset("nav footer aside form dialog menu search noscript template svg object canvas audio video select button datalist map applet".split())
#: What an article is written in; inside one, these aren't told by how often they recur.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption details summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class or an id, and roles.
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs colophon comment comments
complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter
notice notices notification pager pagination popup promo promos promotion related recommended recommendations reply replies respond search
share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar trending widget widgets""".split())
ARTICLE = frozenset("article-body articlebody article-content article-text entry-content post-content post-body story-body main-content".split())

#: A block with as many words outside of links is prose and no template, wherever it recurs.
LONG = 50

_AT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_REST = re.compile(r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+>""")
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
_P, _NOT_P = frozenset({"p"}), BLOCK - {"p"}
#: Start tag: the open element that it ends, and what this doesn't reach beyond.
_ENDED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "td", "th"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    **{t: (HEADING, BLOCK - HEADING) for t in HEADING}}


class Page(NamedTuple):
    """Texts of the blocks that are no template by what they are, and the elements that may be one by how often they recur."""

    blocks: list[str]
    #: (hash, first block, block after the last, whether only a share of the host's pages tells it)
    elements: list[tuple[int, int, int, bool]]
    #: A hash of the blocks: copies of a page have the same.
    content: int


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "left_out", "by_name", "whole_name", "article", "main", "head", "heading", "first", "mark", "parts", "words", "long", "region", "title")

    def __init__(self, tag: str, above: _Element | None, attributes: dict[str, str] | None, first: int, mark: int):
        self.tag, self.first, self.mark, self.parts, self.words = tag, first, mark, [], 0
        self.long = self.by_name = self.whole_name = False
        self.title = tag == "h1"
        if above is None:
            self.main = self.article = self.head = self.heading = self.left_out = self.region = False
            return
        inside = above.main or above.article
        self.left_out = tag in LEFT_OUT or tag == "header" and not inside
        self.head = above.head or tag == "header" and inside
        self.heading = above.heading or tag in HEADING
        self.main = above.main or tag == "main"
        self.article = above.article or tag == "article"
        self.region = tag in ("main", "article")
        if attributes:
            self.named(above, attributes)

    def named(self, above: _Element, attributes: dict[str, str]) -> None:
        """What class, id, role and style say."""
        self.left_out |= "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        given = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split()
        self.whole_name = any(v.lower() in NAMES for v in given)
        self.by_name = self.whole_name or self.tag != "article" and any(p.lower() in NAMES for v in given for p in _PART.findall(v))
        if self.by_name:
            self.main, self.article, self.region = above.main, above.article, False
            return
        named = any(v.lower() in ARTICLE for v in given) or attributes.get("itemprop", "").lower() == "articlebody"
        main = attributes.get("role", "").lower() == "main"
        self.main, self.article, self.region = self.main or main, self.article or named, self.region or main or named


def page(source: str) -> Page:
    """Blocks and elements of a page."""
    stack = [_Element("", None, None, 0, 0)]
    opened: dict[str, int] = {}
    blocks: list[list] = []  # text, left out, in main, in an article
    elements: list[tuple[int, int, int, bool]] = []
    buffer: list[str] = []
    linked = 0  # words of the buffer that stand in links
    link = False

    def flush():
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            top = stack[-1]
            words = text.count(" ") + 1 - linked
            top.words += words
            top.long = top.long or words >= LONG
            top.parts.append(text)
            blocks.append([text, top.head and not top.heading, top.main, top.article])
        buffer.clear()
        linked = 0

    def close():
        e = stack.pop()
        above = stack[-1]
        opened[e.tag] -= 1
        gone = e.left_out and not e.region and (not e.long if e.tag == "form" else True) or e.by_name and not e.region and (e.whole_name or not e.title)
        if gone:
            for b in blocks[e.first:]:
                b[1] = True
            if e.tag not in BLOCK and len(blocks) == e.first:
                del buffer[e.mark:]  # what stands around an inline element is one block
        if e.tag in BLOCK and e.parts:
            h = _hash("\0".join([e.tag, *e.parts]).encode("utf-8", "surrogatepass"))
            above.parts.append(f"{h:x}")
            if not e.long and not e.region and not (e.article and e.tag in PROSE and not gone):
                elements.append((h, e.first, len(blocks), e.tag in PROSE))
        else:
            above.parts += e.parts
        above.words += e.words
        above.long = above.long or e.long and not gone
        above.region, above.title = above.region or e.region and not gone, above.title or e.title

    def pop_to(tags, bounds):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                if stack[k].tag in BLOCK:
                    flush()
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in bounds:
                return

    at, n = 0, len(source)
    while at < n:
        m = _AT.search(source, at)
        raw = source[at: m.start()] if m else source[at:]
        if raw:
            text = unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if link:
                linked += len(text.split())
        if m is None:
            break
        if m[3]:
            end = source.find("-->", m.start() + 2)
            at = n if end < 0 else end + 3
            continue
        rest = _REST.match(source, m.end())
        at = rest.end() if rest else n
        if not m[2] or rest is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            elif opened.get(tag):
                if tag in BLOCK:
                    pop_to({tag}, ())
                else:
                    pop_to({tag}, BLOCK)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = _ENDS[tag].search(source, at)
            if end is None:
                break
            rest = _REST.match(source, end.end())
            at = rest.end() if rest else n
            continue
        if tag == "a":
            link = True
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest[0])} if len(rest[0]) > 1 else None
        if tag in BLOCK:
            flush()
            if opened.get("p"):
                pop_to(_P, _NOT_P)
            if tag in _ENDED:
                pop_to(*_ENDED[tag])
        elif not attributes and tag not in LEFT_OUT or tag in ("html", "body"):
            continue
        e = _Element(tag, stack[-1], attributes, len(blocks), len(buffer))
        if tag not in BLOCK and not (e.left_out or e.by_name):
            continue
        stack.append(e)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    while len(stack) > 1:
        close()

    kept = [not b[1] for b in blocks]
    for region in (2, 3):
        if any(k and b[region] for k, b in zip(kept, blocks, strict=True)):
            kept = [k and b[region] for k, b in zip(kept, blocks, strict=True)]
            break
    place = [0]
    for k in kept:
        place.append(place[-1] + k)
    texts = [b[0] for k, b in zip(kept, blocks, strict=True) if k]
    return Page(texts, [(h, place[a], place[b], share) for h, a, b, share in elements], _hash("\0".join(texts).encode("utf-8", "surrogatepass")))
