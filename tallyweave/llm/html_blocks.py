"""A page of HTML as a tree of its block elements and the text blocks between their tags.

Tags are read as browsers read them where pages commonly break the rules: elements that the next one ends (``p``, ``li``, ``td``, …) need no
end tag, an end tag without its start is skipped, and what stands open at the end is closed. Inline tags are markup only; whatever stands
between two tags of blocks is one block of text, ``br`` is white space in it. Character references are decoded, also without semicolon
where HTML allows it. Text in comments, scripts, styles and other raw elements is none. Nesting beyond ``DEEPEST`` levels is taken as flat.
Every step looks at a character a bounded number of times, whatever the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Browsers, too, take deeper nesting as flat.
DEEPEST = 512

# Element names of HTML.
RAW = frozenset({"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
PARAGRAPH_ENDING = HEADINGS | {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
BLOCKS = PARAGRAPH_ENDING | {
    "audio", "body", "button", "canvas", "caption", "dd", "dt", "head", "html", "label", "legend", "li", "noscript", "object", "optgroup", "option", "select", "svg", "tbody", "td",
    "template", "tfoot", "th", "thead", "tr", "video",
}
#: What a start tag ends, if open inside the named bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
PARAGRAPH_BOUNDS = frozenset({"td", "th", "table", "button", "object", "caption", "template"})

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
TAG_WITHOUT_QUOTES = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·¿¡»«“”„]")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    attributes: dict[str, str]


@dataclass(slots=True)
class Block:
    """Text between two tags of block elements; ``plain`` counts the characters outside links."""

    element: int
    text: str
    plain: int
    punctuation: int


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, {})])
    blocks: list[Block] = field(default_factory=list)


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


class _Reader:
    """The open elements and the pieces of the block that is being read."""

    def __init__(self) -> None:
        self.page = Page()
        self.open: list[int] = [0]
        self.pieces: list[tuple[str, bool]] = []
        self.links = 0

    def tag_of(self, i: int) -> str:
        return self.page.elements[i].tag

    def text(self, piece: str) -> None:
        if piece:
            self.pieces.append((unescape(piece) if "&" in piece else piece, self.links > 0))

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(p for p, _ in self.pieces).split())
            if text:
                plain = sum(len("".join(p.split())) for p, linked in self.pieces if not linked)
                self.page.blocks.append(Block(self.open[-1], text, plain, len(PUNCTUATION.findall(text))))
            self.pieces = []

    def close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str], innermost: bool) -> None:
        """End open elements up to one of ``tags``, the innermost or the outermost inside ``bounds``."""
        cut = None
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag_of(self.open[k])
            if tag in tags:
                cut = k
                if innermost:
                    break
            elif tag in bounds:
                break
        if cut is not None:
            del self.open[cut:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links = 1
        elif tag == "br":
            self.pieces.append((" ", True))
        elif tag == "hr":
            self.end_block()
            self.close({"p"}, PARAGRAPH_BOUNDS, True)
        elif tag in BLOCKS:
            self.end_block()
            if tag in PARAGRAPH_ENDING:
                self.close({"p"}, PARAGRAPH_BOUNDS, True)
            if tag in HEADINGS and self.tag_of(self.open[-1]) in HEADINGS:
                del self.open[-1]
            if tag in ENDS:
                self.close(*ENDS[tag], False)
            parent = self.open[-1]
            depth = self.page.elements[parent].depth + 1
            if depth <= DEEPEST:
                self.page.elements.append(Element(tag, parent, depth, attributes_of(attributes) if attributes.strip(" /") else {}))
                self.open.append(len(self.page.elements) - 1)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        elif tag in BLOCKS:
            self.end_block()
            self.links = 0
            if tag == "p":
                self.close({"p"}, PARAGRAPH_BOUNDS, True)
            elif tag in ENDS:
                self.close({tag}, ENDS[tag][1], True)
            elif tag in HEADINGS:
                self.close(HEADINGS, PARAGRAPH_ENDING - HEADINGS, True)
            elif tag not in ("html", "body"):
                self.close({tag}, frozenset(), True)
        elif tag == "br":
            self.pieces.append((" ", True))


def read_page(html: str) -> Page:
    reader, at, size, pattern = _Reader(), 0, len(html), TAG
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            reader.text(html[at:])
            break
        if mark > at:
            reader.text(html[at:mark])
        following = html[mark + 1 : mark + 2]
        if following in ("!", "?"):
            comment = html.startswith("<!--", mark)
            end = html.find("-->" if comment else ">", mark + (2 if comment else 1))
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        if not (following == "/" or (following.isascii() and following.isalpha())):
            reader.text("<")
            at = mark + 1
            continue
        tag = pattern.match(html, mark)
        if tag is None and following == "/" and not html[mark + 2 : mark + 3].isalpha():
            end = html.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        if tag is None and pattern is TAG:
            # A quote that never closes: from here on quotes are plain characters, so that no text is read again and again.
            pattern = TAG_WITHOUT_QUOTES
            tag = pattern.match(html, mark)
        if tag is None:
            break
        closing, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
        at = tag.end()
        if closing:
            reader.end(name)
        elif name in RAW:
            if name not in ("script", "style"):
                reader.end_block()
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            if end is None:
                break
            close = html.find(">", end.end())
            at = size if close < 0 else close + 1
        else:
            reader.start(name, attributes)
            if name not in VOID and attributes.endswith("/") and name in ("svg", "canvas", "object"):
                reader.end(name)
    reader.end_block()
    return reader.page
