"""Leaf blocks of a web page: stretches of text that no block element divides, with the elements around them.

One pass over the tags with a stack of open block elements. Missing end tags are implied as browsers imply them
(a paragraph ends where a block begins, an item where the next begins), stray ones are passed over, and a page
may end anywhere. The content of scripts, styles, the head, controls and other elements that show no text of
their own is left out. Each tag is read once and the stack is searched through indexes, so time is linear.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

# Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSHOWN = frozenset("head noscript template svg math select button datalist canvas audio video object".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ANY_HEADING = tuple(sorted(_HEADINGS))
_CELLS = frozenset(("td", "th"))
_ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr".split()) | {"hr"}
#: Elements that a start tag closes, and those that shield what lies below them.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "td", "th")),
    "dd": (("dd", "dt"), ("dl", "td", "th")),
    "dt": (("dd", "dt"), ("dl", "td", "th")),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    **{h: (_ANY_HEADING, ("div", "section", "article", "td", "th", "li")) for h in _HEADINGS},
}
_P = (("p",), ("td", "th", "caption", "table"))

#: After the name of a tag: quotes count only behind an equals sign.
_REST = r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>"""
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)" + _REST)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}

#: In labelled pages the elements that hold main text, or text that is none again, carry it with 1 or 0.
LABEL = "data-main"


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    marks: frozenset[str]  # elements around it, and the words of their classes and ids
    near: frozenset[str]  # those words of the nearest element that has any
    container: int
    linked: int  # characters within links, before white space is put together
    main: bool


@lru_cache(maxsize=4_096)
def _marks(tag: str, attributes: str) -> tuple[frozenset[str], str]:
    """Marks of an element from its tag, and its label if it has one."""
    found, label = {f"in:{tag}"}, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            found.update(f"c:{p.lower()}" for p in _PART.findall(value) if len(p) > 1)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value:
            found.add("hidden")
        elif name == LABEL:
            label = value
    return frozenset(found), label


class _Page:
    def __init__(self, known: frozenset[str] | None) -> None:
        self.known = known
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, frozenset[str], frozenset[str], int, bool]] = [("", frozenset(), frozenset(), 0, False)]
        self.places: dict[str, list[int]] = {}  # of open elements, by tag
        self.pieces: list[str] = []
        self.linked = 0
        self.link = 0  # depth of the stack where the open link began, or 0
        self.unshown = 0  # the same of the element that shows nothing
        self.made = 0

    def add(self, raw: str) -> None:
        if not self.unshown:
            piece = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(piece)
            if self.link:
                self.linked += len(piece)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                tag, marks, near, number, main = self.stack[-1]
                inner = tag in ("p", "li", "dd", "dt", "td", "th") or tag in _HEADINGS
                container = self.stack[-2][3] if inner and len(self.stack) > 1 else number
                self.blocks.append(Block(text, tag, marks, near, container, self.linked, main))
            self.pieces, self.linked = [], 0

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_from(self, depth: int) -> None:
        self.flush()
        for tag, *_ in self.stack[depth:]:
            self.places[tag].pop()
        del self.stack[depth:]
        if self.link > depth:
            self.link = 0
        if self.unshown >= depth:
            self.unshown = 0

    def hide(self, tag: str) -> None:
        """An element without text begins; what stands around it is one block."""
        self.places.setdefault(tag, []).append(len(self.stack))
        self.unshown = self.unshown or len(self.stack)
        self.stack.append((tag, *self.stack[-1][1:]))

    def show(self, tag: str) -> None:
        depth = self.last((tag,))
        if depth and depth == len(self.stack) - 1:
            self.stack.pop()
            self.places[tag].pop()
            self.unshown = 0 if self.unshown >= depth else self.unshown
        elif depth:
            self.close_from(depth)

    def open(self, tag: str, attributes: str) -> None:
        if self.places.get("head"):
            self.close_from(self.places["head"][-1])
        if tag in _ENDS_P:
            self.imply(*_P)
        if tag in _IMPLIED:
            self.imply(*_IMPLIED[tag])
        self.flush()
        _, marks, near, _, main = self.stack[-1]
        # long attributes are data, and not worth keeping
        own, label = _marks(tag, attributes) if len(attributes) < 500 else _marks.__wrapped__(tag, attributes)
        if self.known is not None:
            own &= self.known
        self.made += 1
        self.places.setdefault(tag, []).append(len(self.stack))
        names = frozenset(m for m in own if m[:2] == "c:") or near
        self.stack.append((tag, marks if own <= marks else marks | own, names, self.made, label == "1" if label else main))

    def imply(self, ended: tuple[str, ...], shields: tuple[str, ...]) -> None:
        depth = self.last(ended)
        if depth and depth > self.last(shields):
            self.close_from(depth)

    def close(self, tag: str) -> None:
        depth = self.last(_ANY_HEADING if tag in _HEADINGS else (tag,))
        table_part = tag in _CELLS or tag in ("table", "tr", "tbody", "thead", "tfoot", "caption")
        if depth and (table_part or depth > self.last(("td", "th", "caption"))):
            self.close_from(depth)
        else:
            self.flush()


def _is_name(c: str) -> bool:
    return c.isascii() and c.isalpha()


def leaf_blocks(source: str, known: frozenset[str] | None = None) -> tuple[list[Block], str]:
    """(leaf blocks in page order, title of the page); of the marks only the ``known`` ones, if they are given."""
    page, at, title, end = _Page(known), 0, "", len(source)
    while at < end:
        start = source.find("<", at)
        if start != at:
            page.add(source[at : start if start >= 0 else end])
        if start < 0:
            break
        after = source[start + 1 : start + 2]
        if after in ("!", "?") or after == "/" and not _is_name(source[start + 2 : start + 3]):
            comment = source.startswith("<!--", start)
            stop = source.find("-->" if comment else ">", start + 2)
            if stop < 0:
                break
            at = stop + (3 if comment else 1)
            continue
        if after != "/" and not _is_name(after):
            page.add("<")
            at = start + 1
            continue
        found = _TAG.match(source, start)
        if found is None:
            break  # the page ends within a tag
        at = found.end()
        closing, tag, attributes = found[1], found[2].lower(), found[3]
        if closing:
            if tag in BLOCKS or "-" in tag:
                page.close(tag)
            elif tag == "a":
                page.link = 0
            elif tag in UNSHOWN:
                page.show(tag)
            elif tag == "br":
                page.add(" ")
        elif tag in RAW:
            stop = _RAW_END[tag].search(source, at)
            if tag == "title" and not title and not page.places.get("svg"):
                title = " ".join(html.unescape(source[at : stop.start() if stop else end]).split())
            if stop is None:
                break
            at = stop.start()
        elif tag in BLOCKS or "-" in tag:
            page.open(tag, attributes)
        elif tag in UNSHOWN and not attributes.endswith("/"):
            page.hide(tag)
        elif tag == "a":
            page.link = len(page.stack)
        elif tag in ("br", "hr"):
            if tag == "hr":
                page.flush()
            page.add(" ")
    page.flush()
    return page.blocks, title
